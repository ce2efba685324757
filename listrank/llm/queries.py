"""The registered queries of this subpackage, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontam, licenses, line_dedup, mixing, quality_model, quality_rules, sharding, simhash, toxicity
from .common import LOOSE_WORD, LOWER, SPACE_WORD, UPPER, table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mix(table(spark, sf_dir, "documents"))
    rows = plan.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    copies = mixing.row_copies(F.col("copies"), F.col("m"), F.col("nth"))
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"), "source")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.find_contamination(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "found.*")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.apply_rules(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), line_dedup.host_of(F.col("url")).alias("host"), line_dedup.html_lines(F.col("html")).alias("lines"))
    out = line_dedup.drop_boilerplate(pages)
    kept = F.array_join("kept_lines", "\n")
    return out.select(F.col("id").alias("page_id"), "host", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept_lines")).cast("long").alias("n_dropped"), F.md5(kept.cast("binary")).alias("kept_md5"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    out = quality_model.classify(docs, table(spark, sf_dir, "labels"), keep_text=False)
    return out.select("doc_id", "source", "lang", "quality.*")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    rows = rows.unionByName(spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema))
    out = chat_format.format_paths(chat_format.conversation_nodes(rows))
    out = out.withColumn("turns", chat_format.read_turns(F.col("formatted"))).withColumn("loss", chat_format.read_loss(F.col("formatted"), F.col("loss_spans")))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(F.col("tree_id").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.score_toxicity(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.CUT).cast("int").alias("predicted"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    starts = F.transform("places", lambda p: p["start"].cast("long"))
    return out.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents").select("doc_id"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_mix_sources, op2_decontaminate, op3_quality_rules, op4_line_dedup, op5_quality_classifier, op6_chat_format, op7_simhash, op8_toxicity, op9_license_scan, op10_sharding, pipeline)
}

_LOOSE = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{LOOSE_WORD}')"

_OP2 = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, {_LOOSE} AS w FROM documents),
items AS (SELECT item_id, w, least(10, len(w)) AS k FROM (SELECT item_id, {_LOOSE} AS w FROM benchmark) WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM items)),
spots AS (SELECT rid, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM items))),
hits AS (SELECT rid, k, i, item_id FROM spots JOIN wins USING (k, g)),
words AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM hits) GROUP BY rid),
found AS (SELECT rid, count(*) AS n, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT rid, item_id::VARCHAR AS s FROM hits) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(found.n, 0)::BIGINT AS n_items,
  sha256(coalesce(found.s, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (rid) LEFT JOIN found USING (rid)"""


def _op3() -> str:
    classes = ["[A-Z]", "[0-9]", r"[\x20\x09-\x0D]", r"[.,;:!?''\"()\-]", r"[#$%&*+/<=>@\[\\\]\^_`{|}~]", r"[^\x09-\x0D\x20-\x7E]"]
    counts = ", ".join(f"len(regexp_extract_all(t, '{c}')) AS c{i + 1}" for i, c in enumerate(classes))
    width, listed = quality_rules.N_COMMON, ", ".join(f"'{x}'" for x in quality_rules.COMMON_WORDS)
    cases = []
    for i in range(width):
        by = " ".join(f"WHEN '{lang}' THEN len(list_filter(lw, lambda x: x = '{ws[i]}'))" for lang, ws in quality_rules.COMMON_WORDS.items())
        cases.append(f"CASE lang {by} ELSE len(list_filter(lw, lambda x: x = tops[{i + 1}])) END AS w{i}")
    c, w = [f"c{i}" for i in range(7)], [f"w{i}" for i in range(width + 1)]
    sums = ", ".join(f"sum({x})::DOUBLE AS r{x}" for x in c + w)

    def distance(columns: list[str]) -> str:
        p, q = f"greatest({'+'.join(columns)}, 1)", f"greatest({'+'.join('r' + x for x in columns)}, 1)"
        part = lambda a, b: f"CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0 END"
        return "sqrt(greatest(" + " + ".join(f"({part(f'({x} / {p})', f'(r{x} / {q})')} + {part(f'(r{x} / {q})', f'({x} / {p})')}) / 2" for x in columns) + ", 0))"

    return rf"""
WITH a AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{SPACE_WORD}') AS ws FROM documents),
g AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM a)),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) AS k FROM g) WHERE k > 1) GROUP BY rid),
b AS (SELECT a.rid, doc_id, lang, len(ws) AS n_words, len(t) AS chars, list_transform(ws, lambda x: lower(x)) AS lw, {counts}, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{SPACE_WORD}')) AS lines, coalesce(rep.n, 0) AS n_repeat_words FROM a LEFT JOIN rep USING (rid)),
bf AS (SELECT *, chars - c1 - c2 - c3 - c4 - c5 - c6 AS c0, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM b),
o AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(list_distinct(lw)) AS word FROM bf WHERE NOT base_failed AND lang NOT IN ({listed})) GROUP BY lang, word),
own AS (SELECT lang, list(word ORDER BY k) AS tops FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS k FROM o) WHERE k <= {width}
  AND lang IN (SELECT lang FROM bf WHERE NOT base_failed GROUP BY lang HAVING count(*) >= {quality_rules.LEAST_DOCS}) GROUP BY lang),
e AS (SELECT bf.*, tops, {", ".join(cases)} FROM bf LEFT JOIN own USING (lang)),
f AS (SELECT *, n_words - ({"+".join(w[:-1])}) AS {w[-1]} FROM e),
r AS (SELECT lang, {sums} FROM f WHERE NOT base_failed GROUP BY lang),
d AS (SELECT f.*, CASE WHEN chars >= {quality_rules.LEAST_CHARS} THEN {distance(c)} END AS dc, CASE WHEN n_words >= {quality_rules.LEAST_WORDS_COMMON} AND (f.lang IN ({listed}) OR tops IS NOT NULL) THEN {distance(w)} END AS dw FROM f LEFT JOIN r ON f.lang IS NOT DISTINCT FROM r.lang)
SELECT doc_id, n_words::BIGINT AS n_words, (chars - c3)::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND coalesce(dc, 0) <= {quality_rules.CHAR_LIMIT} AND coalesce(dw, 0) <= {quality_rules.WORD_LIMIT} AS kept FROM d"""


_OP4 = rf"""
WITH p AS (SELECT row_number() OVER () AS rid, page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/:?#]+)', 1)), '') AS host,
  list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(html, '{line_dedup._HIDDEN}', ' ', 'g'), '{line_dedup._BREAKS}', chr(10), 'g'), '<[^>]*>', '', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM pages),
t AS (SELECT host, count(*) AS n FROM p WHERE host IS NOT NULL GROUP BY host),
c AS (SELECT host, line, count(*) AS k FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM p WHERE host IS NOT NULL) GROUP BY host, line),
b AS (SELECT host, list(line) AS common FROM c JOIN t USING (host) WHERE k >= {line_dedup.LEAST_PAGES} AND k > {line_dedup.RATIO} * n GROUP BY host),
k AS (SELECT rid, page_id, p.host, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(common, []), x)) AS kept FROM p LEFT JOIN b ON p.host = b.host)
SELECT page_id, host, len(lines)::BIGINT AS n_lines, (len(lines) - len(kept))::BIGINT AS n_dropped, md5(coalesce(array_to_string(kept, chr(10)), '')) AS kept_md5 FROM k"""

_OP6 = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
e AS (SELECT *, length(text) + length(regexp_replace(text, '[^\\<#]', '', 'g')) + length(role) + length(regexp_replace(role, '[^\\<#\n]', '', 'g')) + length('<turn>' || chr(10) || '</turn>' || chr(10)) AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""


def _op9() -> str:
    places = " UNION ALL ".join(
        f"SELECT rid, i - 1 AS pos, '{label}' AS label FROM (SELECT rid, w, unnest(range(1, len(w) - {len(p.split()) - 2})) AS i FROM d) WHERE w[i:i + {len(p.split()) - 1}] = {p.split()!r}" for p, label in licenses.PHRASES
    )
    sets = ", ".join(f"({i}, '{label}', {len(text.split())}, {sorted(set(text.split()))!r})" for i, (label, text) in enumerate(licenses.TEMPLATES))
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {_LOOSE} AS w FROM documents),
places AS ({places}),
base AS (SELECT rid, count(*) AS n, min(pos) AS lo, max(pos) AS hi FROM places GROUP BY rid),
t AS (SELECT * FROM (VALUES {sets}) AS t(tid, label, width, ws)),
m AS (SELECT rid, label, len(list_intersect(list_distinct(w[i:i + width - 1]), ws)) / len(ws) AS c FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM d), t WHERE list_contains(ws, w[i])),
hit AS (SELECT rid, label, max(c) AS c FROM m WHERE c >= {licenses.CONTAINMENT} - 1e-12 GROUP BY rid, label),
allof AS (SELECT rid, label, true AS is_base, 1.0::DOUBLE AS c FROM places UNION ALL SELECT rid, label, false, c FROM hit),
s AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE is_base) AS base_labels, max(c) AS score FROM allof GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN base USING (rid) LEFT JOIN s USING (rid)"""


def _op10() -> str:
    """The slot of each id, and the shard from the filled table as a list; the fill is a loop, held by a test."""
    return f"""SELECT doc_id, slot, {sharding.lookup_table(sharding.SHARDS)!r}[slot + 1] AS shard
FROM (SELECT doc_id, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {sharding.SLOTS})::INTEGER AS slot FROM documents)"""


ORACLE_SQL = {"op10_sharding": _op10(), "op2_decontaminate": _OP2, "op3_quality_rules": _op3(), "op4_line_dedup": _OP4, "op6_chat_format": _OP6, "op9_license_scan": _op9()}
