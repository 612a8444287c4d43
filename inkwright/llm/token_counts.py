"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from ._arrow import chunks, map_texts, texts

_MODELS: dict[str, object] = {}
#: A single space between two characters that are no word marks: no piece of the vocabulary spans it.
_SAFE = re.compile("(?<=[^ ▁]) (?=[^ ▁])")


def load(path: str):
    """The processor for a model file, once per Python worker."""
    if path not in _MODELS:
        import sentencepiece

        _MODELS[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _MODELS[path]


def split_safely(text: str, most: int) -> list[str]:
    """Cut a text at safe spaces into parts of about `most` characters; the space itself is dropped.

    The encoder puts a word mark in front of every text, which stands for the space that is left
    out, so the parts' token counts add up to the whole text's. A text without a safe space stays whole.
    """
    parts, start = [], 0
    while len(text) - start > most and (found := _SAFE.search(text, start + most)):
        parts.append(text[start : found.start()])
        start = found.end()
    return [*parts, text[start:]]


def spans_words(path: str) -> bool:
    """Whether some piece has a word mark behind another character, so that no space would be safe."""
    model = load(path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return any("▁" in p.strip("▁") or (p.strip("▁") and p.endswith("▁")) for p in pieces)


def count_tokens(df: DataFrame, model_path: str, limit: int = 4096, split_chars: int = 32_768, batch_bytes: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row.

    Null or empty text: zero bytes and zero tokens. Null ids and repeated rows pass through, one
    row each. Texts longer than split_chars are cut at safe boundaries, so one very long text
    never makes one very long encoder call. Other columns are ignored; an empty table gives none.
    """
    splittable = not spans_words(model_path)

    def encode(ids: list, values: list[str]) -> dict[str, list]:
        model = load(model_path)
        parts, owner = [], []
        for i, text in enumerate(values):
            for part in split_safely(text, split_chars) if splittable and len(text) > split_chars else [text]:
                parts.append(part)
                owner.append(i)
        counts = [0] * len(values)
        for i, j in chunks(parts, [len(p.encode()) for p in parts], batch_bytes):
            for k, ids_of in zip(owner[i:j], model.encode(parts[i:j], num_threads=1)):
                counts[k] += len(ids_of)
        return {"doc_id": ids, "n_bytes": [len(t.encode()) for t in values], "n_tokens": counts, "over_limit": [n > limit for n in counts]}

    return map_texts(texts(df, id_col, text_col), encode, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
