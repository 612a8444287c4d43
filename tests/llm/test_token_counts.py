import sentencepiece

from inkwright.llm import token_counts
from inkwright.llm.registry import tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")


def test_counts_equal_the_library(odd, none, docs):
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for df in (odd, docs):
        want = sorted((r.doc_id is None, r.doc_id or 0, len((r.text or "").encode()), len(model.encode(r.text or ""))) for r in df.collect())
        got = token_counts.count_tokens(df, PATH, split_chars=500).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 4096) for r in got)
    assert token_counts.count_tokens(none, PATH).count() == 0


def test_safe_boundaries():
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for text in ("a  b   c d " * 400, "▁x ▁ y" * 300, "漢字 かな " * 300, "nospace" * 2000, " lead and trail ", "tab\tnew\n line" * 200, "<s> </s> <unk> " * 99):
        parts = token_counts.split_safely(text, 50)
        assert sum(len(model.encode(p)) for p in parts) == len(model.encode(text)), text[:20]
    assert not token_counts.spans_words(PATH)
