"""One query per operator over its whole table, and the SQL of those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm import (
    bpe, chat, decontaminate, html_text, language, manifest, merkle, mixing, simhash, spelling, suffixes, tokens,
    toxicity,
)
from cellweave.llm.common import id_remainder

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by source as flat as two readings of the rarest source allow."""
    docs = table(spark, sf_dir, "documents")
    return mixing.mixture(docs, max_repetition=2.0, block_tokens=200_000, seed=42)


OP1_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) + 1 AS BIGINT) AS tokens
  FROM documents
), totals AS (
  SELECT source, CAST(sum(tokens) AS BIGINT) AS n FROM docs GROUP BY source
), bisection AS (
  SELECT 0 AS low, 1000000 AS high, (SELECT list(n ORDER BY source) FROM totals) AS ns
  UNION ALL
  SELECT CASE WHEN meets THEN low ELSE middle + 1 END, CASE WHEN meets THEN middle ELSE high END, ns
  FROM (
    SELECT *, list_max(list_transform(range(1, len(ns) + 1), lambda i: ns[i] / r[i]))
              * list_max(list_transform(range(1, len(ns) + 1), lambda i: r[i] / ns[i])) <= 2.0 AS meets
    FROM (
      SELECT *, (low + high) // 2 AS middle,
             list_transform(ns, lambda n: pow(n / list_sum(ns), ((low + high) // 2) / 1000000.0)) AS r
      FROM bisection WHERE low < high
    )
  )
), exponent AS (
  SELECT max(low) / 1000000.0 AS a FROM bisection WHERE low = high
), weights AS (
  SELECT source, n, r / sum(r) OVER () AS w
  FROM (SELECT source, n, pow(n / (SELECT sum(n) FROM totals), (SELECT a FROM exponent)) AS r FROM totals)
), budgets AS (
  SELECT *, CAST(floor(size * w + 0.5) AS BIGINT) AS budget,
         greatest(1, CAST(ceil(size / 200000) AS BIGINT)) AS blocks
  FROM (SELECT *, max(n / w) OVER () AS size FROM weights)
), epochs AS (
  SELECT d.doc_id, d.source, d.tokens, b.n, b.budget, b.blocks,
         unnest(range(CAST(ceil(b.budget / b.n) AS BIGINT))) AS epoch
  FROM docs d JOIN budgets b ON d.source IS NOT DISTINCT FROM b.source
), drawn AS (
  SELECT *, ('0x' || substr(md5('42|' || epoch || '|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::UBIGINT / pow(2, 52) AS u,
         ('0x' || substr(md5('42|block|' || epoch || '|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::UBIGINT / pow(2, 52) AS v
  FROM epochs
), placed AS (
  SELECT *, epoch * n + coalesce(sum(tokens) OVER (
    PARTITION BY source, epoch ORDER BY u, doc_id, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
  FROM drawn
), blocked AS (
  SELECT *, CAST(floor(place / (budget / blocks)) AS INTEGER) AS block FROM placed WHERE place < budget
)
SELECT doc_id, source, tokens, CAST(epoch AS INTEGER) AS epoch, block,
       CAST(row_number() OVER (PARTITION BY block ORDER BY v, doc_id, tokens, epoch) - 1 AS INTEGER) AS position
FROM blocked
"""


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash classes of all documents: 3-word shingles, links at 2 or fewer bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), radius=2, size=3)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in all documents, with up to 8 edits for every 100 characters."""
    benchmark = decontaminate.Benchmark.of(table(spark, sf_dir, "benchmark"))
    return decontaminate.find_contamination(table(spark, sf_dir, "documents"), benchmark)


def language_model(docs: DataFrame) -> language.LanguageModel:
    """Learned from the documents that are not held out."""
    seen = docs.where(id_remainder("doc_id", 4) != 2)
    return language.fit_language_model(seen, F.col("text"), F.col("lang"), F.col("doc_id"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from those whose id's crc32 mod 4 is not 2."""
    docs = table(spark, sf_dir, "documents")
    return language.label_languages(docs, language_model(docs)).select(
        "doc_id",
        (id_remainder("doc_id", 4) == 2).alias("held_out"),
        "lang_pred",
        "score",
        F.size("spans").alias("n_spans"),
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from labels whose id's crc32 mod 5 is not 0."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(id_remainder("doc_id", 5) != 0)
    model = toxicity.fit_toxicity_model(
        docs.select(F.col("doc_id").alias("id"), "text"),
        labels.select(F.col("doc_id").alias("id"), F.col("toxic").alias("label")),
    )
    return toxicity.score_toxicity(docs, model).select(
        "doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted"
    )


def op6_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle fingerprints of all documents and of their edited texts."""
    return merkle.fingerprint_documents(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        F.col("tree.root").alias("fingerprint"),
        F.col("edited_tree.root").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        F.col("changed.section").alias("changed_section"),
        F.col("changed.paragraph").alias("changed_paragraph"),
    )


def root_sql(text: str) -> str:
    paragraphs = "list_transform(string_split(s, chr(10)), lambda p: sha256(p))"
    sections = f"string_split({text}, chr(10) || chr(10))"
    return (
        f"sha256(array_to_string(list_transform({sections}, "
        f"lambda s: sha256(array_to_string({paragraphs}, ''))), ''))"
    )


def phrases_sql(text: str) -> str:
    found = rf"regexp_extract_all({text}, '[^.,;:!?|\n]*[.,;:!?|]?')"
    return f"list_distinct(list_filter(list_transform({found}, lambda x: trim(x)), lambda x: x <> ''))"


def likeness_sql(left: str, right: str) -> str:
    common = f"len(list_intersect({left}_phrases, {right}_phrases))"
    return (
        f"CASE WHEN {left}_root = {right}_root THEN 1.0 ELSE "
        f"2.0 * {common} / (2 + len({left}_phrases) + len({right}_phrases)) END"
    )


OP6_SQL = f"""
WITH numbered AS (
  SELECT doc_id, coalesce(text, '') AS body, row_number() OVER (ORDER BY doc_id) AS n, count(*) OVER () AS total
  FROM documents
), pairs AS (
  SELECT a.doc_id, a.body, b.body AS follower,
         left(a.body, length(a.body) - length(a.body) // 2) || left(b.body, length(a.body) // 2) AS edited
  FROM numbered a JOIN numbered b ON b.n = a.n % a.total + 1
), trees AS (
  SELECT *, {root_sql("body")} AS body_root, {root_sql("edited")} AS edited_root,
         {root_sql("follower")} AS follower_root, {phrases_sql("body")} AS body_phrases,
         {phrases_sql("edited")} AS edited_phrases, {phrases_sql("follower")} AS follower_phrases
  FROM pairs
), located AS (
  SELECT *, string_split(body, chr(10) || chr(10)) AS a, string_split(edited, chr(10) || chr(10)) AS b FROM trees
), sections AS (
  SELECT *, list_position(list_transform(range(1, greatest(len(a), len(b)) + 1),
         lambda i: a[i] IS DISTINCT FROM b[i]), true) AS section FROM located
), paragraphs AS (
  SELECT *, string_split(a[section], chr(10)) AS c, string_split(b[section], chr(10)) AS d FROM sections
)
SELECT doc_id, length(body) AS n_chars, sha256(edited) AS edited_sha256, body_root AS fingerprint,
       edited_root AS edited_fingerprint,
       CAST({likeness_sql("body", "edited")} AS DOUBLE) AS near_edited,
       CAST({likeness_sql("body", "follower")} AS DOUBLE) AS near_next,
       CAST(section - 1 AS INTEGER) AS changed_section,
       CAST(list_position(list_transform(range(1, greatest(coalesce(len(c), 0), coalesce(len(d), 0)) + 1),
            lambda i: c[i] IS DISTINCT FROM d[i]), true) - 1 AS INTEGER) AS changed_paragraph
FROM paragraphs
"""


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of all pages, laid out."""
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of 50 words or more that have occurred before, in all documents."""
    return suffixes.repeated_passages(table(spark, sf_dir, "documents"), min_words=50)


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of all documents, by the line that holds a token's first byte."""
    counted = tokens.token_counts(table(spark, sf_dir, "documents"), rule="begin")
    return counted.select(
        "doc_id", "section", "begin", "end", F.col("n_tokens").cast("bigint").alias("n_tokens"), "n_crossing"
    )


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations with repaired roles, rendered turn by turn."""
    return chat.repair_conversations(table(spark, sf_dir, "conversations"))


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Merkle manifest of all documents by language, with some rows tampered with after it was
    made, and what their proofs then come to."""
    docs = table(spark, sf_dir, "documents")
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    altered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    n_chars = F.when(altered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    claimed = manifest.leaf(*[n_chars if name == "n_chars" else F.col(name) for name in columns])
    made = manifest.manifest(docs, manifest.leaf(*map(F.col, columns)), carried={"claimed": claimed})
    return made.select(
        "doc_id", "leaf", "subroot", "root",
        manifest.proof_digest(F.col("path")).alias("proof_sha256"),
        manifest.folded(F.col("claimed"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


#: Fixed value: the polynomial of CRC-32, reversed.
CRC_SQL = """
bits AS (
  SELECT range AS i, 0 AS step, CAST(range AS UBIGINT) AS c FROM range(256)
  UNION ALL
  SELECT i, step + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM bits WHERE step < 8
), crc_table AS (
  SELECT list(c ORDER BY i) AS steps FROM bits WHERE step = 8
)"""


def crc_sql(octets: str) -> str:
    """crc32 of a list of octets in a query that has ``crc_table``."""
    turn = "xor(steps[CAST(xor(c, b) & 255 AS INTEGER) + 1], c >> 8)"
    return f"xor(list_reduce({octets}, lambda c, b: {turn}, 4294967295::UBIGINT), 4294967295::UBIGINT)"


def field_sql(value: str) -> str:
    return f"coalesce(CAST(octet_length(encode(CAST({value} AS VARCHAR))) AS VARCHAR) || ':' || CAST({value} AS VARCHAR), '-')"


def leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(map(field_sql, ["doc_id", "source", "lang", n_chars, "text"])) + ")"


def tree_sql(name: str, leaves: str) -> str:
    """Table ``name(g, lv, i, h)``: all nodes over ``leaves(g, i, h)``, level by level."""
    return f"""
{name} AS (
  SELECT g, 0 AS lv, i, h, count(*) OVER (PARTITION BY g) AS n FROM {leaves}
  UNION ALL
  SELECT g, lv + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (max(n) + 1) // 2
  FROM {name} WHERE n > 1 GROUP BY g, lv, i // 2
)"""


OP11_SQL = f"""
WITH RECURSIVE {CRC_SQL}, docs AS (
  SELECT doc_id, coalesce('=' || lang, '-') AS g, {leaf_sql("n_chars")} AS leaf,
         CASE WHEN {crc_sql("list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::UBIGINT)")} % 7 = 0
              THEN {leaf_sql("(n_chars + 1)")} ELSE {leaf_sql("n_chars")} END AS claimed
  FROM documents, crc_table
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM docs
), leaves AS (
  SELECT g, i, leaf AS h FROM ordered
), {tree_sql("lower_tree", "leaves")}, subroots AS (
  SELECT g, h AS subroot FROM lower_tree WHERE n = 1
), tops AS (
  SELECT '' AS g, row_number() OVER (ORDER BY encode(g)) - 1 AS i, subroot AS h, g AS lang_key FROM subroots
), {tree_sql("upper_tree", "tops")}, whole AS (
  SELECT h AS root FROM upper_tree WHERE n = 1
), walked AS (
  SELECT o.doc_id, o.leaf, o.claimed, o.g, o.i, 0 AS k, CAST('' AS VARCHAR) AS proof, o.claimed AS at_node FROM ordered o
  UNION ALL
  SELECT w.doc_id, w.leaf, w.claimed, w.g, w.i // 2, w.k + 1, w.proof || coalesce(s.h, ''),
         sha256(CASE WHEN w.i % 2 = 1 THEN s.h || w.at_node ELSE w.at_node || coalesce(s.h, '') END)
  FROM walked w JOIN lower_tree t ON t.g = w.g AND t.lv = w.k AND t.i = w.i AND t.n > 1
  LEFT JOIN lower_tree s ON s.g = w.g AND s.lv = w.k AND s.i = xor(w.i, 1)
), grounded AS (
  SELECT w.doc_id, w.leaf, w.proof, w.at_node, x.subroot, p.i, 0 AS k
  FROM walked w JOIN lower_tree t ON t.g = w.g AND t.lv = w.k AND t.i = w.i AND t.n = 1
  JOIN subroots x ON x.g = w.g JOIN tops p ON p.lang_key = w.g
), climbed AS (
  SELECT * FROM grounded
  UNION ALL
  SELECT w.doc_id, w.leaf, w.proof || coalesce(s.h, ''),
         sha256(CASE WHEN w.i % 2 = 1 THEN s.h || w.at_node ELSE w.at_node || coalesce(s.h, '') END),
         w.subroot, w.i // 2, w.k + 1
  FROM climbed w JOIN upper_tree t ON t.lv = w.k AND t.i = w.i AND t.n > 1
  LEFT JOIN upper_tree s ON s.lv = w.k AND s.i = xor(w.i, 1)
)
SELECT c.doc_id, c.leaf, c.subroot, root, sha256(c.proof) AS proof_sha256, c.at_node AS folded_root,
       c.at_node = root AS verified
FROM climbed c, whole JOIN upper_tree t ON t.n = 1 WHERE c.k = t.lv
"""


OP8_SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos
  FROM (SELECT doc_id, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
        FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)
), windows AS (
  SELECT doc_id, pos, md5(string_agg(word, ' ') OVER run) AS h, count(*) OVER run AS n FROM words
  WINDOW run AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)
), ranked AS (
  SELECT doc_id, pos, row_number() OVER same AS rn, first_value(doc_id) OVER same AS source_id
  FROM windows WHERE n = 50 WINDOW same AS (PARTITION BY h ORDER BY doc_id, pos)
), marked AS (
  SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) <= 50 THEN 0 ELSE 1 END AS new
  FROM ranked WHERE rn > 1
), grouped AS (
  SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS stretch FROM marked
)
SELECT doc_id, CAST(min(pos) AS INTEGER) AS begin, CAST(max(pos) + 50 AS INTEGER) AS "end",
       min(source_id) AS source_id
FROM grouped GROUP BY doc_id, stretch
"""

def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the long words of all documents, some of them planted."""
    words = spelling.word_counts(table(spark, sf_dir, "documents"), min_length=7, min_count=2, drop_one_in=31)
    return spelling.spelling_variants(words, factor=10)


#: Octets of a text in UTF-8 as a list.
OCTETS_SQL = "list_transform(range(octet_length(encode({0}))), lambda i: ('0x' || substr(hex(encode({0})), 2 * i + 1, 2))::UBIGINT)"
OP12_SQL = f"""
WITH RECURSIVE {CRC_SQL}, runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents)
), of_doc AS (
  SELECT doc_id, run, count(*) AS n, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS marked
  FROM runs WHERE length(run) >= 7 GROUP BY doc_id, run
), hashed AS (
  SELECT run, n, {crc_sql(OCTETS_SQL.format("marked"))} AS h FROM of_doc, crc_table
), written AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(run, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2)
              ELSE run END AS word, n FROM hashed
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM written WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), cuts AS (
  SELECT word, n, unnest(range(length(word))) AS i FROM words
), shapes AS (
  SELECT word, n, i, left(word, i) AS head, substr(word, i + 2) AS tail FROM cuts
), near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM shapes a JOIN shapes b
    ON a.i = b.i AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word
  UNION
  SELECT a.word, b.word, b.n FROM shapes a JOIN words b ON a.head || a.tail = b.word
  UNION
  SELECT b.word, a.word, a.n FROM shapes a JOIN words b ON a.head || a.tail = b.word
), best AS (
  SELECT word, count(*) AS n_near, arg_min(near, (-near_n, encode(near))) AS near, max(near_n) AS near_n FROM near GROUP BY word
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * w.n THEN near END AS form,
         CASE WHEN near_n >= 10 * w.n THEN near_n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word
), followed AS (
  SELECT word, word AS root, form AS next FROM forms
  UNION ALL
  SELECT f.word, f.next, g.form FROM followed f JOIN forms g ON g.word = f.next
)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM forms f JOIN followed r ON r.word = f.word AND r.next IS NULL
"""


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of all documents, and the bytes that the tokens come to."""
    coded = bpe.encode(table(spark, sf_dir, "documents"), offsets=False)
    return bpe.decode(coded, text=False, carried=("ids", "n_split")).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "n_split",
    )


QUERIES: dict[str, Query] = {
    "op1_mixing": op1_mixing,
    "op2_simhash": op2_simhash,
    "op3_decontamination": op3_decontamination,
    "op4_language": op4_language,
    "op5_toxicity": op5_toxicity,
    "op6_merkle": op6_merkle,
    "op7_html": op7_html,
    "op8_suffixes": op8_suffixes,
    "op9_tokens": op9_tokens,
    "op10_chat": op10_chat,
    "op11_manifest": op11_manifest,
    "op12_spelling": op12_spelling,
    "op13_bpe": op13_bpe,
}

ORACLES: dict[str, str] = {
    "op1_mixing": OP1_SQL,
    "op6_merkle": OP6_SQL,
    "op8_suffixes": OP8_SQL,
    "op11_manifest": OP11_SQL,
    "op12_spelling": OP12_SQL,
}
