"""Text rules as column expressions; word classes are of letters and digits of any script.

All but nfkc stay in the JVM. Null text gives null, or zero where a rule counts.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwright.functions.arrow import arrow

# The characters, words and patterns that the rules are defined by.
WORD = r"[\p{L}\p{N}]+"
MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december"
FANCY, PLAIN = "‘’‚“”„＿–—‑‒−µ", "'''\"\"\"_-----μ"
SPACING = r"[[\s\p{Z}]&&[^ ]][\s\p{Z}]*| [\s\p{Z}]+"  # runs of white space that are not one space already
VOWELS = "aeiouyáéíóúàèìòùäöüâêîôûãõñç"
LATIN_VOWELS = "aeiouyáéíóúàèìòùâêîôûäëïöüãõåæøœ"
SPACED_ALIKE = ".,;:!?()[]{}\"'“”‘’«»"
PREFIXES = (
    "pre post non anti co re de sub super inter intra multi semi pseudo micro macro over under ultra un dis mis counter extra hyper hypo "
    "meta mid neo pro trans bi tri uni poly mono auto bio geo electro photo thermo hydro immuno neuro cardio radio socio psycho eco pan "
    "peri para iso homo hetero cyto endo"
).split()
FUNCTION_WORDS = "of and the in for with between by to on from at a an as or".split()
CONNECTORS = "and or of the a an to for in on with by & at from as per not".split()
SCRIPTS = ("Latin", "Greek", "Cyrillic", "Arabic", "Hebrew", "Devanagari", "Han", "Hiragana", "Katakana", "Hangul", "Thai")
NUMERIC = r"^[(\[]?[-+−–<>≤≥~≈]?\s*[$€£¥]?\s?[0-9.,]+\s*%?[)\]]?[*†‡a-z]{0,3}$|^[-–—]$|^[nN]/?[aA]$"
STATISTIC = r"^[(\[]\s*[-+−–]?[0-9,]*\.?[0-9]+%?\s*[)\]][*†‡]*$"
PAGE_NUMBER = r"^[\s\-–—.·|]*(?:[0-9]{1,4}|[ivxlcIVXLC]{1,7})[\s\-–—.·|]*$"
LIST_START = r"^\s*(?:[•◦▪●‣⁃■□·]|[-–—*]\s|\(?[0-9]{1,3}[.)]\s|\(?[a-z][.)]\s|\([A-Z]\)\s|[A-Z]\)\s|\(?[ivx]{1,6}[.)]\s)"
NUMBERED = r"^\s*([0-9]{1,2}(?:\.[0-9]{1,2}){0,4})\.?\s+\S"
CAPTION = r"(?i)^\s*(?:figure|fig\.?|table|tab\.?|chart|scheme|plate|exhibit)\s*[0-9IVX]+[.:\-\s]"
SECTION = r"(?i)^\s*(?:abstract|introduction|conclusions?|references|acknowledg\w*|appendix|bibliography|summary|background|methods?|results?|discussion|keywords?)\b[:.]?\s*$"
CONTACT = r"(?i)https?://|www\.|\b[\w.+-]+@[\w-]+\.[\w.]+|\bdoi\b|\bdoi:|journal homepage|available (?:online )?at|downloaded from|\bcopyright\b|©|\bissn\b|\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b"
CRITICAL = r"(?i)\b(?:not|no|never|none|nor|neither|without|unless|except|excepting|excluded|excludes|excluding|exclusion|only|other than|up to|at least|at most|more than|less than|under|over|maximum|minimum|limit|limited)\b|n't\b|[$£€]\s?[0-9][0-9,]*(?:\.[0-9]+)?|\b[0-9][0-9,]*(?:\.[0-9]+)?\s?%|\b[0-9][0-9,]*(?:\.[0-9]+)?\b"
PLAIN_BOUND = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
ENUMERATOR = r"^(?:[A-Za-z]{1,2}\.|[0-9]{1,3}\.|[ivxlcIVXLC]{1,5}\.|\(?[A-Za-z0-9]{1,3}\))\s"


def in_class(chars: str) -> str:
    """The characters escaped for use within brackets of a pattern."""
    return "".join("\\" + c if c in "\\]^-[&" else c for c in chars)


def count_of(text: Column, pattern: str) -> Column:
    """How many characters of the text are of the class [pattern]."""
    return F.length(F.regexp_replace(text, f"[^{pattern}]+", ""))


def count_not(text: Column, pattern: str) -> Column:
    """How many characters of the text are not of the class [pattern]."""
    return F.length(F.regexp_replace(text, f"[{pattern}]+", ""))


def squashed(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[\s\p{Z}]+", " "))


def words(text: Column) -> Column:
    """Lower-cased words."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def long_words(text: Column) -> Column:
    """Lower-cased words of three letters or digits at least."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]{3,}"), F.lit(0))


def tokens(text: Column) -> Column:
    """What lies between white space."""
    return F.regexp_extract_all(text, F.lit(r"[^ \t\r\n]+"), F.lit(0))


def word_count(text: Column) -> Column:
    """Words of two letters or digits at least."""
    return F.size(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]{2,}"), F.lit(0)))


@arrow("string")
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode's compatibility form, which the JVM's SQL functions lack."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@arrow("string")
def nfc(text: pd.Series) -> pd.Series:
    """Unicode's composed form."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def fold(line: Column) -> Column:
    """Numbers to #, then month names to <m>, in lower case: what stays of a line from issue to issue."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(line)), "[0-9]+", "#"), rf"\b(?:{MONTHS})\b", "<m>")


def bigrams(ws: Column) -> Column:
    """Adjacent words as a sorted set; a single word is paired with nothing."""
    pairs = F.filter(F.zip_with(ws, F.slice(ws, F.lit(2), F.size(ws)), lambda a, b: F.concat(a, F.lit(" "), b)), lambda p: p.isNotNull())
    one = F.transform(F.slice(ws, 1, 1), lambda w: F.concat(w, F.lit(" ")))
    return F.array_sort(F.array_distinct(F.when(F.size(ws) == 1, one).otherwise(pairs)))


def bare(token: Column) -> Column:
    """A token without the punctuation around it."""
    return F.regexp_replace(token, r"""^[.,;:!?()\[\]{}"']+|[.,;:!?()\[\]{}"']+$""", "")


def core(token: Column) -> Column:
    """A token without the punctuation and quotation marks around it."""
    ends = in_class(SPACED_ALIKE)
    return F.regexp_replace(token, f"^[{ends}]+|[{ends}]+$", "")


_SYMBOL = r"\p{L}\p{N}\-'’/&."


_PLAIN_WORD = r"^[(\"“]?[A-Za-z]?[a-z]*[aeiouy][a-z]*[.,;:!?)\"”]*$"


def garbled_of(tokens: Column) -> Column:
    """Of an array of tokens those that no language makes, by the first rule that speaks, as structs with their parts.

    Too short, or an address: not. Two symbols beside letters: garbled. Fewer than three letters: not.
    Then garbled are a mark at an end, a symbol inside, a digit between letters, case that rises twice
    inside, and five Latin letters without a vowel. Most tokens leave by the plain rule in front; the parts of the others are made
    once, step by step, as an expression shares nothing within a lambda.
    """
    left = F.transform(F.filter(tokens, lambda t: ~t.rlike(_PLAIN_WORD)), lambda t: F.struct(core(t).alias("c")))
    left = F.filter(left, lambda s: (F.length(s["c"]) >= 4) & ~(F.contains(s["c"], F.lit("://")) | F.startswith(F.lower(s["c"]), F.lit("www.")) | F.contains(s["c"], F.lit("@"))))
    parts = F.transform(left, lambda s: F.struct(s["c"].alias("c"), F.regexp_replace(s["c"], r"[^\p{L}]", "").alias("letters"), F.substring(s["c"], F.lit(2), F.length(s["c"]) - 2).alias("inner"), count_not(s["c"], _SYMBOL).alias("symbols")))

    def rules(s: Column) -> Column:
        c, letters, inner = s["c"], s["letters"], s["inner"]
        return (
            F.when((s["symbols"] >= 2) & (letters != ""), True)
            .when(F.length(letters) < 3, False)
            .when(c.rlike(r"^[~*#|^`]|[~*#|^`]$"), True)
            .when((s["symbols"] > 0) & (count_not(inner, _SYMBOL) > 0), True)
            .when(c.rlike(r"\p{L}\p{Nd}\p{L}"), True)
            .when(inner.rlike(r"\p{Ll}\p{Lu}.*\p{Ll}\p{Lu}"), True)
            .when((F.length(letters) >= 5) & ~F.lower(letters).rlike(f"[{LATIN_VOWELS}]") & (count_not(letters, r"\x{0000}-\x{024F}") == 0), True)
            .otherwise(False)
        )

    return F.filter(parts, rules)


def garbled(token: Column) -> Column:
    """Whether no language makes the token; see garbled_of."""
    return F.size(garbled_of(F.array(token))) > 0


def garbled_in_script(token: Column) -> Column:
    """garbled, judged piece by piece: marks are part of their letters, and scripts without spaces are cut out."""
    plain = F.regexp_replace(token, r"\p{M}", "")
    pieces = F.split(plain, r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}\x{3000}-\x{303F}\x{FF00}-\x{FF0F}\x{FF1A}-\x{FF20}]")
    return F.size(garbled_of(pieces)) > 0


def bad_chars(text: Column) -> Column:
    """Replacement, private-use, unassigned and control characters but tab and line ends."""
    return count_of(text, r"\x{FFFD}\p{Co}\p{Cn}\x{0000}-\x{0008}\x{000B}\x{000C}\x{000E}-\x{001F}\x{007F}-\x{009F}")


def vowel_share(word: Column) -> Column:
    w = F.lower(word)
    return count_of(w, VOWELS) / F.greatest(F.length(w), F.lit(1))


def _end_bare(token: Column) -> Column:
    mark = r"""[.,;:!?()\[\]"'\-]"""
    return F.when(token.rlike(f"^{mark}|{mark}$"), F.regexp_replace(token, f"^{mark}+|{mark}+$", "")).otherwise(token)


def vowel_shares(tokens: Column) -> Column:
    """For each token of an array the vowels' share of its letters, 0.5 of a number and of one or two letters, and -1 of all else.

    Most tokens are letters alone and leave by the first rule; the others are made bare in a step of their own, as an expression shares nothing within a lambda.
    """
    share = lambda c: F.when(c.rlike(r"^(?:\p{N}+|\p{L}{1,2})$"), 0.5).when(c.rlike(r"^\p{L}+$"), vowel_share(c)).otherwise(-1.0)
    plain = lambda t: F.when(F.length(t) <= 2, 0.5).otherwise(vowel_share(t))
    return F.transform(tokens, lambda t: F.when(t.rlike(r"^\p{L}+\z"), plain(t)).otherwise(F.get(F.transform(F.array(_end_bare(t)), share), 0)))


def wordlike(share: Column) -> Column:
    """A number, one or two letters, or letters with a vowel among five; of what vowel_shares gives."""
    return share >= 0.2


def language_like(share: Column) -> Column:
    """wordlike, and not of vowels almost alone."""
    return (share >= 0.2) & (share <= 0.8)


def script(text: Column) -> Column:
    """The script of most letters, the first listed on ties; null without letters of a listed one."""

    def most(rest: Column) -> Column:  # rest: the text without its ASCII, whose letters are Latin
        plain = F.length(F.regexp_replace(text, "[^A-Za-z]+", ""))
        counts = F.array(*[F.struct((count_of(rest, rf"\p{{Is{s}}}") + (plain if s == "Latin" else 0)).alias("n"), F.lit(-i).alias("at"), F.lit(s).alias("script")) for i, s in enumerate(SCRIPTS)])
        return F.array_max(counts)

    # by way of arrays, as their lambdas read the rest and the best once
    best = F.transform(F.array(F.regexp_replace(text, r"[\x00-\x7F]+", "")), most)
    return F.get(F.transform(best, lambda b: F.when(b["n"] > 0, b["script"])), 0)


def normalize(text: Column) -> Column:
    """Markdown emphasis and breaks undone, white space single, quotes and dashes plain; composed forms are nfc's work."""
    out = F.regexp_replace(text, r"<br/?>", " ")
    for pattern, to in ((r"\*\*([^\n]*?)\*\*", "$1"), (r"__([^\n]*?)__", "$1"), (r"</?[bi]>", ""), (r"\*([^\n]*?)\*", "$1"), (r"_([^\n]*?)_", "$1"), (SPACING, " ")):
        out = F.regexp_replace(out, pattern, to)
    # translate looks up each character, so it is for texts that have one of those; by way of an array, as its lambda reads the rest once
    return F.get(F.transform(F.array(out), lambda t: F.when(t.rlike(r"[µ\x{2011}-\x{201E}−＿]"), F.translate(t, FANCY, PLAIN)).otherwise(t)), 0)


def token_list(text: Column, markup: bool = False) -> Column:
    """Lower-cased words of print: markup out, words broken at a line's end or hyphenated made one."""
    out = text
    if markup:
        for pattern in (r"!\[[^\]]*\]\([^)]*\)", r"<[^>]{1,200}>", r"&[a-z]{2,6};", r"\\[A-Za-z]+"):
            out = F.regexp_replace(out, pattern, " ")
    out = F.regexp_replace(out, "([ﬀ-ﬆ]) ", "$1")
    out = F.replace(out, F.lit("­"), F.lit(""))
    out = F.regexp_replace(out, r"-(?<=[\p{L}\p{N}_]-)\s*\n\s*(?=[\p{L}\p{N}_])", "")  # the hyphen first, so that only hyphens are looked behind
    out = F.regexp_replace(out, r"-(?<=[\p{L}\p{N}_]-)(?=[\p{L}\p{N}_])", "")
    out = F.regexp_replace(out, r"[\x{E000}-\x{F8FF}]", " ")
    return words(out)


def unescape(text: Column) -> Column:
    """Markdown escapes undone."""
    return F.regexp_replace(text, r"\\([\\`*_{}\[\]()#+.!|$&<>-])", "$1")


def html_escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def html_unescape(text: Column) -> Column:
    pairs = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)


def md_cell(text: Column) -> Column:
    """A cell of a pipe table: bars and dollars escaped, one line."""
    return F.replace(F.trim(F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))), F.lit("$"), F.lit("\\$"))


def alt_text(text: Column) -> Column:
    """Text that may stand as a picture's description."""
    return F.translate(squashed(text), "[]", "()")


def plain_cell(text: Column) -> Column:
    """A cell as words: markup, escapes and typographic variants out, case folded, list marks in front dropped."""
    out = html_unescape(F.regexp_replace(text, r"<[^>]+>", " "))
    for a, b in (("\\$", "$"), ("\\|", "|"), ("**", ""), ("*", "")):
        out = F.replace(out, F.lit(a), F.lit(b))
    out = F.translate(out, "’‘“”–—", "''\"\"--")
    return F.lower(squashed(F.regexp_replace(out, r"^[\s•·-]+", "")))


def mark_of(text: Column) -> Column:
    """tick, cross or nothing: the mark that a cell opens with."""
    lead = F.substring(plain_cell(text), 1, 1)
    return F.when(lead.rlike("[✓✔☑]"), "tick").when(lead.rlike("[✗✘☒✕✖]"), "cross").otherwise("")


def critical(text: Column, plain_bounds: bool = False) -> Column:
    """The negations, limits and figures of a text, in order, without their spaces and commas.

    With plain_bounds a word ends before any letter but A-Z, as in engines that know no other word characters.
    """
    found = F.regexp_extract_all(text, F.lit(CRITICAL.replace(r"\b", PLAIN_BOUND) if plain_bounds else CRITICAL), F.lit(0))
    return F.transform(found, lambda w: F.regexp_replace(F.lower(w), r"[\s,]", ""))


def punct_parts(text: Column) -> Column:
    """Space behind , ; and : that are glued to a word of two letters at least; addresses are let be."""
    token = lambda t: F.when(t.rlike(r"://|@|www\."), t).otherwise(F.regexp_replace(t, r"([,;:])([A-Za-z]{2})", "$1 $2"))
    return F.array_join(F.transform(tokens(text), token), " ")


def furniture(line: Column) -> Column:
    """What may run at a page's edge: a page number, capitals throughout, or a short caseless line with a digit."""
    text = F.trim(line)
    n = F.size(tokens(text))
    cased = count_of(text, r"\p{Lu}\p{Ll}\p{Lt}")
    return (text != "") & (n <= 8) & (
        text.rlike(PAGE_NUMBER) | F.when(cased > 0, (cased >= 3) & (count_of(text, r"\p{Ll}\p{Lt}") == 0)).otherwise((n <= 4) & text.rlike(r"\p{Nd}"))
    )


def witness_key(text: Column) -> Column:
    """Lower case, all but letters and digits one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def line_key(text: Column) -> Column:
    """What two readings of a line would agree on."""
    return F.array_join(words(text), " ")


def same_line(a: Column, b: Column) -> Column:
    """Keys that are equal, or one of twelve characters at least that is three fifths or more of the other."""
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    return (a == b) | ((a != "") & (b != "") & (short >= 12) & (short >= 0.6 * long) & (F.contains(a, b) | F.contains(b, a)))


def in_order(needles: Column, hay: Column) -> Column:
    """Whether the words occur in the other list in their order, others between."""
    return F.aggregate(hay, F.lit(0), lambda at, w: F.when(w == F.get(needles, at), at + 1).otherwise(at)) >= F.size(needles)


def printed_chars(text: Column) -> Column:
    """Characters that stand for print: front matter, tags, table rules, bars and blanks are not."""
    out = F.regexp_replace(text, r"(?s)\A---[ \t]*\n.*?\n---[ \t]*\n", "")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    out = F.regexp_replace(out, r"(?m)^[ \t|:-]+$", "")
    return count_not(out, r"|\s\p{Z}")


def capacity(width: Column, height: Column) -> Column:
    """Characters that a region can hold at the smallest legible type: 4 points high, 2 wide."""
    return F.greatest(width, F.lit(0.0)) * F.greatest(height, F.lit(0.0)) / 8.0


def load(text: Column, width: Column, height: Column) -> Column:
    room = capacity(width, height)
    return F.when(room > 0, printed_chars(text) / room).otherwise(F.lit(0.0))


def page_number(text: Column) -> Column:
    return text.rlike(PAGE_NUMBER)


def continues(above: Column, below: Column) -> Column:
    """Whether a cell's line reads as the continuation of the one above."""
    a, b = F.trim(above), F.trim(below)
    last = F.lower(F.regexp_extract(a, r"(\S+)$", 1))
    return (a != "") & (b != "") & (b.rlike(r"^[\p{Ll}(\[]") | a.rlike(r"[,;:\-–&/]$") | last.isin(CONNECTORS))


def paragraph_continues(above: Column, below: Column) -> Column:
    """Whether a paragraph runs on over a page or column break."""
    return (above != "") & (below != "") & ~above.rlike(r"^(?:#|\||<table)") & ~above.rlike(r"""[.!?:"')\]]\s*$""") & (below.rlike(r"^\p{Ll}") | above.rlike(r"-\s*$"))


def join_broken(above: Column, below: Column) -> Column:
    """Two lines as one without a dictionary: a hyphen closes up before lower case and stays before the rest."""
    return (
        F.when(above == "", below).when(below == "", above)
        .when(above.rlike(r"[^ ]-$") & below.rlike(r"^\p{Ll}"), F.concat(F.regexp_replace(above, "-$", ""), below))
        .when(above.rlike(r"[^ ]-$"), F.concat(above, below))
        .otherwise(F.concat_ws(" ", above, below))
    )


def join_lines(lines: Column) -> Column:
    """An array of lines as one paragraph, in the form that needs no dictionary."""
    return F.aggregate(F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != ""), F.lit(""), lambda out, line: join_broken(out, line))


def list_item(text: Column, level: Column) -> Column:
    """A list entry of markdown: the mark made plain, two spaces for each level."""
    pad = F.repeat(F.lit("  "), (F.least(F.greatest(level, F.lit(1)), F.lit(4)) - 1).cast("int"))
    bullet, number = r"(?s)^\s*[•◦▪●‣⁃■□·\-–—*]\s*(.*)$", r"(?s)^\s*\(?([0-9]{1,3})[.)]\s*(.*)$"
    body = (
        F.when(text.rlike(bullet), F.concat(F.lit("- "), F.trim(F.regexp_extract(text, bullet, 1))))
        .when(text.rlike(number), F.concat(F.regexp_extract(text, number, 1), F.lit(". "), F.trim(F.regexp_extract(text, number, 2))))
        .otherwise(F.trim(text))
    )
    return F.concat(pad, body)


HEAD = 65_536  # characters of a body that are looked at before all of it is


def title_of(body: Column) -> Column:
    """The first heading that says something, 200 characters of it; null without one."""
    found = lambda t: F.regexp_extract(t, r"(?m)^#+[ \t]*([^\s#][^\n]*)$", 1)
    head = F.substring(body, 1, HEAD)
    whole = F.substring(head, F.lit(1), F.length(head) - F.length(F.substring_index(head, "\n", -1)))  # its last line may be cut
    return F.nullif(F.trim(F.substring(F.when(found(whole) != "", found(whole)).otherwise(found(body)), 1, 200)), F.lit(""))


def description_of(body: Column) -> Column:
    """The first sentence of six words in a real paragraph, else the first sentence at all; 200 characters at most.

    It nearly always stands in a body's head; only where it does not is all of a long body cut into paragraphs.
    """
    cut = F.split(F.substring(body, 1, HEAD), "\n\n")
    good, _ = _sentences(F.when(F.length(body) > HEAD, F.slice(cut, F.lit(1), F.size(cut) - 1)).otherwise(cut))
    return F.coalesce(good, *_sentences(F.split(body, "\n\n")))


def _sentences(pieces: Column) -> tuple[Column, Column]:
    """The first sentence of six words in a real paragraph, and the first sentence at all."""
    paragraphs = F.filter(F.transform(pieces, lambda p: F.trim(p)), lambda p: (p != "") & ~p.rlike(r"^(?:#|\||!|\\\[|- |\* |<!--)"))

    def sentence(p):
        flat = squashed(p)
        first = F.regexp_extract(flat, r"^(.+?[.!?])(?:\s|$)", 1)
        s = F.when(first != "", first).otherwise(flat)
        return F.when(F.length(s) > 200, F.concat(F.rtrim(F.substring(s, 1, 197)), F.lit("..."))).otherwise(s)

    sentences = F.transform(paragraphs, sentence)
    good = F.filter(sentences, lambda s: (F.size(tokens(s)) >= 6) & ~F.endswith(s, F.lit(":")))
    return F.get(good, 0), F.get(sentences, 0)


def statistic(text: Column) -> Column:
    """A number in brackets, as is set under the value it belongs to."""
    return F.trim(text).rlike(STATISTIC)


def numeric_cell(text: Column) -> Column:
    return F.trim(text).rlike(NUMERIC)


def clean_cell(text: Column) -> Column:
    """A cell without leader dots and dashes at its ends; one that is nothing else stays."""
    t = F.trim(text)
    inner = F.trim(F.regexp_replace(F.regexp_replace(t, r"^(?:[.·…]\s?){2,}|(?:\s?[.·…]){3,}$", ""), r"^[-–—_]{2,}\s*|\s*[-–—_]{2,}$", ""))
    return F.when(inner.rlike(r"[\p{L}\p{N}]"), inner).otherwise(t)


def first_hex(name: Column, of: int) -> Column:
    """The first eight hex digits of the name's SHA-1, modulo."""
    return F.conv(F.substring(F.sha1(name.cast("binary")), 1, 8), 16, 10).cast("long") % of


def sha_mod5(name: Column) -> Column:
    """The name's whole SHA-1 modulo 5: sixteen is one there, so the digits' sum will do."""
    digits = F.filter(F.split(F.sha1(name.cast("binary")), ""), lambda d: d != "")
    return F.aggregate(digits, F.lit(0), lambda s, d: s + F.conv(d, 16, 10).cast("int")) % 5


def formula_ampersands(span: Column) -> Column:
    """Bare & of a formula escaped, unless it opens an environment."""
    return F.when(F.contains(span, F.lit("\\begin{")), span).otherwise(F.regexp_replace(span, r"(?<!\\)&", r"\\&"))


def share(part: Column, whole: Column) -> Column:
    """part / whole, and 0 of nothing."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))
