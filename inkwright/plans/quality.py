"""Queries over texts as pages: quality, readings' gates, bags of words, completion and plain text rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwright.functions import text as T
from inkwright.operators import bags as B
from inkwright.operators import quality as Q
from inkwright.operators import render
from inkwright.sources import adapters as A

from ._named import Named

query = Named()


def docs(spark, sf_dir):
    return A.read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def _rep(c: str, p: str, to: str = "") -> str:
    return f"regexp_replace({c}, '{p}', '{to}', 'g')"


SYM = r"\p{L}\p{N}\-''’/&."
TOKENS = r"regexp_extract_all(text, '[^ \t\r\n]+')"
BARE = lambda c: rf"""regexp_replace(regexp_replace({c}, '^[.,;:!?()\[\]{{}}"'']+', ''), '[.,;:!?()\[\]{{}}"'']+$', '')"""
CORE = lambda c: rf"""regexp_replace(regexp_replace({c}, '^[.,;:!?()\[\]{{}}"''“”‘’«»]+', ''), '[.,;:!?()\[\]{{}}"''“”‘’«»]+$', '')"""
ENDS = lambda c: rf"""regexp_replace(regexp_replace({c}, '^[.,;:!?()\[\]"''\-]+', ''), '[.,;:!?()\[\]"''\-]+$', '')"""
CHARS = rf"""ch AS (SELECT doc_id, length({_rep('text', r'[\s\p{Z}]')}) AS n_chars, length({_rep('text', r'[^\p{L}\p{N}]')}) AS n_alnum,
  length({_rep('text', r'[^\x{FFFD}\p{Co}\x{0000}-\x{0008}\x{000B}\x{000C}\x{000E}-\x{001F}\x{007F}-\x{009F}]')}) AS n_bad FROM documents)"""
GARBLED = rf"""tk AS (SELECT doc_id, unnest({TOKENS}) AS t FROM documents), co AS (SELECT doc_id, t, {CORE('t')} AS c, {_rep(CORE('t'), r'[^\p{L}]')} AS le FROM tk),
 inn AS (SELECT *, substring(c, 2, greatest(length(c) - 2, 0)) AS mid, length({_rep('c', f'[{SYM}]')}) AS sy FROM co),
 gb AS (SELECT doc_id, t, length({BARE('t')}) >= 4 AS judged, CASE WHEN length(c) < 4 THEN false WHEN contains(c, '://') OR lower(c) LIKE 'www.%' OR contains(c, '@') THEN false
   WHEN sy >= 2 AND le <> '' THEN true WHEN length(le) < 3 THEN false WHEN regexp_matches(c, '^[~*#|^`]|[~*#|^`]$') THEN true WHEN length({_rep('mid', f'[{SYM}]')}) > 0 THEN true
   WHEN regexp_matches(c, '\p{{L}}\p{{Nd}}\p{{L}}') THEN true WHEN length(mid) - length({_rep('mid', r'\p{Ll}\p{Lu}', '1')}) >= 2 THEN true
   WHEN length(le) >= 5 AND length({_rep('le', r'[\x{0000}-\x{024F}]')}) = 0 AND length({_rep('lower(le)', '[^aeiouyáéíóúàèìòùâêîôûäëïöüãõåæøœ]')}) = 0 THEN true ELSE false END AS garbled FROM inn),
 gs AS (SELECT doc_id, count(*) FILTER (judged) AS judged, count(*) FILTER (judged AND garbled) AS garbled FROM gb GROUP BY doc_id)"""
VOWEL = f"""length({_rep('lower(e)', '[^aeiouyáéíóúàèìòùäöüâêîôûãõñç]')}) / greatest(length(e), 1)"""
WORDLIKE = rf"""wt AS (SELECT doc_id, {ENDS('t')} AS e FROM (SELECT doc_id, unnest({TOKENS}) AS t FROM documents)),
 wl AS (SELECT doc_id, count(*) AS n, count(*) FILTER (regexp_full_match(e, '\p{{N}}+|\p{{L}}{{1,2}}') OR (regexp_full_match(e, '\p{{L}}+') AND {VOWEL} >= 0.2)) AS w,
   count(*) FILTER (regexp_full_match(e, '\p{{N}}+|\p{{L}}{{1,2}}') OR (regexp_full_match(e, '\p{{L}}+') AND {VOWEL} >= 0.2 AND {VOWEL} <= 0.8)) AS l FROM wt GROUP BY doc_id)"""


@query(f"WITH {CHARS} SELECT doc_id, n_chars, n_alnum, n_bad, CASE WHEN n_chars > 0 THEN n_bad / n_chars ELSE 0 END AS bad_share FROM ch")
def bad_char_share(spark, sf_dir):
    return Q.char_counts(docs(spark, sf_dir)).select("doc_id", "n_chars", "n_alnum", "n_bad", "bad_share")


@query(f"WITH {GARBLED} SELECT d.doc_id, coalesce(judged, 0) AS judged, coalesce(garbled, 0) AS garbled, CASE WHEN judged > 0 THEN garbled / judged ELSE 0 END AS garbage_share FROM documents d LEFT JOIN gs ON gs.doc_id = d.doc_id")
def garbled_share(spark, sf_dir):
    return Q.token_shares(docs(spark, sf_dir)).select("doc_id", "judged", "garbled", "garbage_share")


@query(f"WITH {WORDLIKE} SELECT d.doc_id, CASE WHEN n > 0 THEN w / n ELSE 0 END AS wordlike_share FROM documents d LEFT JOIN wl ON wl.doc_id = d.doc_id")
def wordlike_share(spark, sf_dir):
    return Q.token_shares(docs(spark, sf_dir)).select("doc_id", "wordlike_share")


@query(f"WITH {WORDLIKE} SELECT d.doc_id, CASE WHEN n > 0 THEN l / n ELSE 0 END AS language_share FROM documents d LEFT JOIN wl ON wl.doc_id = d.doc_id")
def language_like_share(spark, sf_dir):
    return Q.token_shares(docs(spark, sf_dir)).select("doc_id", "language_share")


_SCRIPTS = ", ".join(f"{{'n': length({_rep('text', f'[^\\p{{{s}}}]')}), 'at': {-i}, 's': '{s}'}}" for i, s in enumerate(T.SCRIPTS))


@query(f"SELECT doc_id, CASE WHEN b.n > 0 THEN b.s END AS script FROM (SELECT doc_id, list_sort([{_SCRIPTS}])[-1] AS b FROM documents)")
def dominant_script(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.script(F.col("text")).alias("script"))


KIND = """CASE WHEN n_alnum < 20 THEN 'none' WHEN n_chars > 0 AND n_bad / n_chars > 0.2 THEN 'suspect' WHEN coalesce(judged, 0) >= 30 AND garbled / judged > 0.2 THEN 'suspect' ELSE 'digital' END"""


@query(f"WITH {CHARS}, {GARBLED} SELECT ch.doc_id, {KIND} AS kind, {KIND} = 'digital' AS usable FROM ch LEFT JOIN gs ON gs.doc_id = ch.doc_id")
def text_quality_kind(spark, sf_dir):
    return Q.assessed(docs(spark, sf_dir)).select("doc_id", "kind", "usable")


@query(f"""WITH {CHARS}, {GARBLED}, k AS (SELECT d.source AS file, CASE WHEN {KIND} = 'digital' THEN 9 ELSE 0 END AS t FROM ch JOIN (SELECT doc_id, source FROM documents) d ON d.doc_id = ch.doc_id LEFT JOIN gs ON gs.doc_id = ch.doc_id)
  SELECT file, CAST(sum(t) AS BIGINT) / (count(*) * 10) AS confidence FROM k GROUP BY file""")
def confidence(spark, sf_dir):
    own = A.read(spark, sf_dir, "documents").select(F.col("source").alias("file"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return Q.confidence(Q.assessed(own), "file")


SEVERITY = "CASE event_type WHEN 'error' THEN 2 WHEN 'purchase' THEN 1 ELSE 0 END"


def issue_rows(spark, sf_dir):
    severity = F.when(F.col("event_type") == "error", "incomplete").when(F.col("event_type") == "purchase", "degraded").otherwise("note")
    return A.read(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.col("event_type").alias("code"), severity.alias("severity"), F.concat_ws(" ", "event_type", "props").alias("message"))


@query(f"SELECT user_id, count(*) AS issues, CASE max({SEVERITY}) WHEN 2 THEN 'incomplete' WHEN 1 THEN 'degraded' ELSE 'complete' END AS completion FROM events GROUP BY user_id")
def completion_by_user(spark, sf_dir):
    return Q.completion(issue_rows(spark, sf_dir), "user_id")


@query(f"""WITH i AS (SELECT user_id, event_type AS code, CASE {SEVERITY} WHEN 2 THEN 'incomplete' WHEN 1 THEN 'degraded' ELSE 'note' END AS severity, event_type || ' ' || props AS message FROM events),
  t AS (SELECT * FROM i WHERE severity <> 'note') SELECT * FROM t UNION ALL
  SELECT user_id, 'warning', 'note', message FROM i WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.user_id = i.user_id AND t.message = i.message)""")
def document_issues(spark, sf_dir):
    rows = issue_rows(spark, sf_dir)
    return Q.all_issues(rows.filter("severity <> 'note'"), rows.select("user_id", "message"), "user_id")


@query("SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS token FROM (SELECT doc_id, "
       + _rep(_rep(_rep("replace(text, chr(173), '')", r"([\p{L}\p{N}_])-\s*\n\s*([\p{L}\p{N}_])", r"\1\2"), r"([\p{L}\p{N}_])-([\p{L}\p{N}_])", r"\1\2"), r"([\p{L}\p{N}_])-([\p{L}\p{N}_])", r"\1\2") + " AS text FROM documents)) GROUP BY ALL")
def word_bag(spark, sf_dir):
    return B.bag(docs(spark, sf_dir), ["doc_id"])


TURNS = r"""WITH t AS (SELECT conv_id, role, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS token FROM conversations WHERE role IN ('user', 'assistant')),
  b AS (SELECT conv_id, token, count(*) FILTER (role = 'user') AS p, count(*) FILTER (role = 'assistant') AS w FROM t GROUP BY conv_id, token)"""


def _turns(spark, sf_dir):
    rows = A.read(spark, sf_dir, "conversations")
    return [B.bag(rows.filter(F.col("role") == r), ["conv_id"]) for r in ("user", "assistant")]


@query(TURNS + " SELECT conv_id, token, p - w AS lost FROM b WHERE p > w")
def word_bag_lost(spark, sf_dir):
    return B.difference(*_turns(spark, sf_dir), ["conv_id"]).filter("lost > 0").select("conv_id", "token", "lost")


@query(TURNS + " SELECT conv_id, token, w - p AS added FROM b WHERE w > p")
def word_bag_added(spark, sf_dir):
    return B.difference(*_turns(spark, sf_dir), ["conv_id"]).filter("added > 0").select("conv_id", "token", "added")


@query()
def word_check(spark, sf_dir):
    rows = A.read(spark, sf_dir, "documents")
    old, new = (A.pages(rows.filter(f"doc_id % 2 = {k}")).select("file", "page", F.col("text").alias(name)) for k, name in ((0, "printed"), (1, "written")))
    return B.word_check(old.join(new, ["file", "page"], "full").withColumn("accounted", F.lit("")), ["file", "page"])


@query(r"SELECT token, n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS token, count(*) AS n FROM documents GROUP BY token) ORDER BY n DESC, token LIMIT 50")
def vocab_top_k(spark, sf_dir):
    words = docs(spark, sf_dir).select(F.explode(T.words(F.col("text"))).alias("token"))
    return words.groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(50)


PRINTED = _rep(_rep(_rep(r"regexp_replace(text, '(?s)\A---[ \t]*\n.*?\n---[ \t]*\n', '')", "<[^>]+>", " "), r"(?m)^[ \t|:-]+$"), r"[|\s\p{Z}]")
LOAD = f"ld AS (SELECT doc_id, length({PRINTED}) / (468.0::DOUBLE * 14.0 * len(string_split(text, chr(10))) / 8.0) AS load FROM documents)"


def _loads(spark, sf_dir):
    return docs(spark, sf_dir).withColumns({"width": F.lit(468.0), "height": 14.0 * F.size(F.split("text", "\n"))})


@query(f"WITH {LOAD} SELECT doc_id, load FROM ld")
def capacity_load(spark, sf_dir):
    return _loads(spark, sf_dir).select("doc_id", T.load(F.col("text"), F.col("width"), F.col("height")).alias("load"))


@query(r"SELECT source AS file, CAST(arg_max(size, (w, -size)) AS BIGINT) AS body_size FROM (SELECT source, length(text) % 7 + 6 AS size, CAST(sum(length(text)) AS BIGINT) AS w FROM documents GROUP BY ALL) GROUP BY source")
def body_size_mode(spark, sf_dir):
    rows = A.read(spark, sf_dir, "documents").select(F.col("source").alias("file"), "text", (F.length("text") % 7 + 6).alias("size"))
    return Q.body_size(rows, "file").withColumn("body_size", F.col("body_size").cast("long"))


@query(r"SELECT doc_id, " + _rep(_rep(_rep(_rep(_rep(_rep(_rep("text", "<br/?>", " "), r"\*\*([^\n]*?)\*\*", r"\1"), r"__([^\n]*?)__", r"\1"), "</?[bi]>"), r"\*([^\n]*?)\*", r"\1"), r"_([^\n]*?)_", r"\1"), r"[\s\p{Z}]+", " ").join(("translate(", ", '‘’‚“”„＿–—‑‒−µ', '''''''\"\"\"_-----μ')")) + " AS text FROM documents")
def normalize_text(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.normalize(F.col("text")).alias("text"))


@query("SELECT doc_id, pos, regexp_replace(regexp_replace(lower(trim(line)), '[0-9]+', '#', 'g'), '\\b(?:" + T.MONTHS + ")\\b', '<m>', 'g') AS fold FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS line FROM documents)")
def fold_numbers_months(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("doc_id", "pos", T.fold(F.col("line")).alias("fold"))


@query(r"SELECT doc_id, " + _rep("text", r"\\([\\`*_{}\[\]()#+.!|$&<>-])", r"\1") + " AS text FROM documents")
def unescape_markdown(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.unescape(F.col("text")).alias("text"))


@query(r"SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS text FROM pages")
def html_escape(spark, sf_dir):
    return A.read(spark, sf_dir, "pages").select("page_id", T.html_escape(F.col("html")).alias("text"))


@query(r"SELECT doc_id, replace(trim(replace(replace(text, '|', '\|'), chr(10), ' ')), '$', '\$') AS cell FROM documents")
def md_cell(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.md_cell(F.col("text")).alias("cell"))


@query(r"SELECT doc_id, translate(trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g')), '[]', '()') AS alt FROM documents")
def alt_text(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.alt_text(F.col("text")).alias("alt"))


@query(r"SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '[^ \t\r\n]+'), lambda t: CASE WHEN regexp_matches(t, '://|@|www\.') THEN t ELSE regexp_replace(t, '([,;:])([A-Za-z]{2})', '\1 \2', 'g') END), ' ') AS text FROM documents")
def punct_split(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.punct_parts(F.col("text")).alias("text"))


@query(r"SELECT doc_id, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) AS key FROM documents")
def witness_keys(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.witness_key(F.col("text")).alias("key"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}]{2,}')) AS words FROM documents")
def own_words(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.word_count(F.col("text")).alias("words"))


FURNITURE = r"""SELECT doc_id, pos FROM (SELECT doc_id, pos, trim(line) AS t, len(regexp_extract_all(line, '[^ \t\r\n]+')) AS n, length(regexp_replace(line, '[^\p{Lu}\p{Ll}\p{Lt}]', '', 'g')) AS cased, length(regexp_replace(line, '[^\p{Ll}\p{Lt}]', '', 'g')) AS low
  FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS line FROM documents))
  WHERE t <> '' AND n <= 8 AND (regexp_matches(t, '^[\s\-–—.·|]*(?:[0-9]{1,4}|[ivxlcIVXLC]{1,7})[\s\-–—.·|]*$') OR CASE WHEN cased > 0 THEN cased >= 3 AND low = 0 ELSE n <= 4 AND regexp_matches(t, '\p{Nd}') END)"""


@query(FURNITURE)
def furniture_lines(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).filter(T.furniture(F.col("line"))).select("doc_id", "pos")


@query(r"SELECT doc_id, nullif(trim(substring(regexp_extract(text, '(?m)^#+[ \t]*([^\s#][^\n]*)$', 1), 1, 200)), '') AS title FROM documents")
def title_from_body(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.title_of(F.col("text")).alias("title"))


DESCRIPTION = r"""WITH p AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS i, trim(unnest(string_split(text, chr(10) || chr(10))), chr(32)) AS p FROM documents),
 f AS (SELECT doc_id, i, trim(regexp_replace(p, '[\s\p{Z}]+', ' ', 'g')) AS p FROM p WHERE p <> '' AND NOT regexp_matches(p, '^(?:#|\||!|\\\[|- |\* |<!--)')),
 s AS (SELECT doc_id, i, CASE WHEN regexp_matches(p, '^(.+?[.!?])(?:\s|$)') THEN regexp_extract(p, '^(.+?[.!?])(?:\s|$)', 1) ELSE p END AS s FROM f),
 c AS (SELECT doc_id, i, CASE WHEN length(s) > 200 THEN rtrim(substring(s, 1, 197)) || '...' ELSE s END AS s FROM s)
 SELECT d.doc_id, coalesce((SELECT arg_min(s, i) FROM c WHERE c.doc_id = d.doc_id AND len(regexp_extract_all(s, '[^ \t\r\n]+')) >= 6 AND NOT s LIKE '%:'), (SELECT arg_min(s, i) FROM c WHERE c.doc_id = d.doc_id)) AS description FROM documents d"""


@query(DESCRIPTION)
def description_sentence(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.description_of(F.col("text")).alias("description"))


@query(r"""SELECT doc_id, list_reduce(list_prepend('', list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')), lambda o, t: CASE WHEN o = '' THEN t
  WHEN regexp_matches(o, '[^ ]-$') AND regexp_matches(t, '^\p{Ll}') THEN regexp_replace(o, '-$', '') || t WHEN regexp_matches(o, '[^ ]-$') THEN o || t ELSE o || ' ' || t END) AS paragraph FROM documents""")
def paragraph_join(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.join_lines(F.split("text", "\n")).alias("paragraph"))


@query()
def hyphen_join(spark, sf_dir):
    text = docs(spark, sf_dir)
    vocabulary = text.select(F.explode(T.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n")).filter("n >= 5")
    lines = text.select("doc_id", F.split("text", "\n").alias("lines"))
    above, below = F.slice("lines", F.lit(1), F.size("lines") - 1), F.slice("lines", F.lit(2), F.size("lines") - 1)
    pair = F.posexplode(F.arrays_zip(above.alias("above"), below.alias("below"))).alias("pos", "pair")
    rows = lines.select("doc_id", pair).select("doc_id", "pos", F.concat("pair.above", F.lit("-")).alias("above"), "pair.below")
    return render.hyphen_join(rows, vocabulary)


@query(r"SELECT doc_id, CASE WHEN regexp_matches(text, '[✓✔✗✘☑☒]') THEN 'marks' WHEN contains(text, '<table') OR regexp_matches(text, '(?m)^\| ---') THEN 'table' WHEN len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^\s*[-*] |^\s*[0-9]{1,2}\. '))) >= 3 THEN 'list' ELSE 'prose' END AS kind FROM documents")
def output_kind(spark, sf_dir):
    from inkwright.operators import forms

    return docs(spark, sf_dir).select("doc_id", forms.kind_of(F.col("text")).alias("kind"))


QUERIES, ORACLES = query.queries, query.oracles
