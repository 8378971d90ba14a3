"""The queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.llm import chat, codes, decontaminate, licenses, linededup, neardup, packing, phrases, pii, quality, repeats, topk, warc
from docweft.llm.common import table


def op4_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document that loses sentences and each document that has a first occurrence of them."""
    out = repeats.affected(table(spark, sf_dir, "documents"))
    words = F.array_join(F.filter(F.split(F.lower("text"), r"\s+", -1), lambda w: w != ""), " ")
    return out.select(
        "doc_id",
        "n_sentences",
        "n_removed",
        F.length(words).cast("long").alias("kept_chars"),
        F.sha2(F.encode(words, "UTF-8"), 256).alias("kept_sha256"),
        F.explode("first_doc_ids").alias("first_doc_id"),
    )


def tokenizer_path() -> str:
    """Where the public tokenizer's file lies; a parameter of the operators."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree: every thirteenth is a licence file, two directories above the others."""
    docs = table(spark, sf_dir, "documents")
    top = (F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")))
    number = F.col("doc_id").cast("string")
    deep = F.concat_ws("/", *top, F.concat(F.lit("a"), F.pmod("doc_id", F.lit(7)).cast("string")), F.concat(F.lit("b"), F.pmod("doc_id", F.lit(3)).cast("string")), F.concat(number, F.lit(".txt")))
    path = F.when(F.pmod("doc_id", F.lit(13)) == 0, F.concat_ws("/", *top, F.concat(F.lit("LICENSE-"), number))).otherwise(deep)
    found = licenses.scan(docs.select(path.alias("path"), "text"))
    doc_id = F.regexp_extract("path", r"/(?:LICENSE-)?(-?[0-9]+)(?:\.txt)?$", 1).cast("long")
    return found.select(doc_id.alias("doc_id"), "path", "own_license", F.round("own_score", 6).alias("own_score"), "license", "license_dir")


def pii_digest(docs: DataFrame) -> DataFrame:
    """Counts and digests of the spans of every row of ``docs``."""
    rows = docs.select("doc_id", "text")
    found = pii.with_spans(rows, pii.fit(rows), base_col="base", spans_col="all")
    def count(rank: int) -> Column:
        return F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")

    counts = [count(rank).alias(f"n_{name}") for rank, name in enumerate(pii.BASE)]
    return found.select(
        "doc_id", *counts, F.sha2(F.encode(pii.as_text(F.col("base")), "UTF-8"), 256).alias("base_sha256"), pii.as_text(F.col("all")).alias("spans")
    )


def op2_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(table(spark, sf_dir, "documents"))


def op3_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=2048)


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op7_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), least_bytes=0)


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    done = chat.format_chat(rows)
    turns = F.transform(chat.read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    lost = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: chat.unescape(s["text"]))
    return done.select(
        "conv_id", turns.alias("turns"), F.array_join(lost, "").alias("lost"), "formatted", "valid", "bad_turn"
    ).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(F.array_join("turns", ""), "UTF-8"), 256).alias("turns_sha256"),
        F.length("lost").cast("long").alias("loss_chars"),
        F.sha2(F.encode("lost", "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        F.col("bad_turn").cast("long").alias("bad_turn"),
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.classify(docs, table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), most=3, least=10, inside_percent=50, top=2000)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codes.compress(table(spark, sf_dir, "embeddings"))
    digest = F.lit(books.digest() if books else None).cast("string")
    return coded.select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_pii_weak_supervision": op2_pii_weak_supervision,
    "op3_bbit_minhash": op3_bbit_minhash,
    "op4_sentence_spans": op4_sentence_spans,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_exact_topk": op6_exact_topk,
    "op7_templates": op7_templates,
    "op8_warc": op8_warc,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_quality": op10_quality,
    "op11_phrases": op11_phrases,
    "op12_vector_codes": op12_vector_codes,
    "op13_line_dedup": op13_line_dedup,
}


def _code_rounds() -> str:
    """The rounds of codebook training as common table expressions."""
    out = []
    for k in range(5):
        out.append(f"""
a{k} AS (SELECT i, p, x, arg_min((idx, d), (d, idx)) AS best FROM (SELECT v.i, v.p, v.x, c.idx, list_dot_product(v.x, v.x) - 2 * list_dot_product(v.x, c.x) + list_dot_product(c.x, c.x) AS d FROM v JOIN c{k} c USING (p)) GROUP BY 1, 2, 3)""")
        if k < 4:
            out.append(f"""
m{k} AS (SELECT p, idx, list(m ORDER BY j) AS x FROM (SELECT p, best[1] AS idx, j, floor(sum(x[j]) / count(*)) AS m FROM a{k}, (SELECT unnest(range(1, 1 + (SELECT max(len(x)) FROM v))) AS j) GROUP BY 1, 2, 3) GROUP BY 1, 2),
c{k + 1} AS (SELECT p, idx, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN m{k} m USING (p, idx))""")
    return ",".join(out)


_STRIPPED = decontaminate._STRIP.replace("'", "''")
_CLOSING = "\"''()[]{}«»“”‘’"
_UNIT_LIST = ", ".join(f"'{u}'" for u in sorted(decontaminate.UNITS))
_LENGTHS = [len(licenses.template_terms(text)) for _, text in licenses.TEMPLATES]
_TEMPLATE_ROWS = ", ".join(
    "({}, '{}', '{}', {}, {})".format(k, name, " ".join(licenses.template_terms(text)), n, licenses.stride(n)) for k, ((name, text), n) in enumerate(zip(licenses.TEMPLATES, _LENGTHS, strict=True))
)

_KNOWN_LIST = ", ".join(f"'{k.lower()}'" for k in licenses.KNOWN)

ORACLES = {
    "op1_license_scan": rf"""
WITH t AS (SELECT * FROM (VALUES {_TEMPLATE_ROWS}) x(k, name, text, size, step)),
tt AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(string_split(text, ' ')) AS term FROM t) GROUP BY 1, 2),
f0 AS (SELECT doc_id, text, coalesce(source, '-') || '/' || coalesce(lang, '-') AS top FROM documents),
f AS (SELECT doc_id, text, CASE WHEN doc_id % 13 = 0 THEN top || '/LICENSE-' || doc_id ELSE top || '/a' || doc_id % 7 || '/b' || doc_id % 3 || '/' || doc_id || '.txt' END AS path,
  doc_id % 13 = 0 AS named, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM f0),
df AS (SELECT term, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(w) AS term FROM f) GROUP BY 1),
idf AS (SELECT term, ln((1.0::DOUBLE + (SELECT count(*) FROM documents)) / (1 + coalesce(n, 0))) + 1 AS idf FROM (SELECT DISTINCT term FROM tt UNION SELECT term FROM df) LEFT JOIN df USING (term)),
v AS (SELECT k, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY k)) AS v FROM tt JOIN idf USING (term)),
-- a window's cosine is at most the norm of the template's terms that the whole text has
c AS (SELECT path, k FROM (SELECT DISTINCT path, unnest(w) AS term FROM f) JOIN v USING (term) GROUP BY 1, 2 HAVING sum(v * v) >= 0.56),
u AS (SELECT path, k, pos, f.w[pos + 1 : pos + size] AS words FROM (SELECT path, k, size, unnest(range(0, len(w), step)) AS pos FROM c JOIN t USING (k) JOIN f USING (path)) JOIN f USING (path)
  UNION ALL SELECT path, k, -1, w FROM c JOIN f USING (path) WHERE named),
x AS (SELECT path, k, pos, len(words) AS size, term, count(*) AS tf FROM (SELECT *, unnest(words) AS term FROM u) GROUP BY ALL),
s AS (SELECT path, x.k, pos, size, round(sum(tf * idf * coalesce(v, 0)) / sqrt(sum(tf * idf * tf * idf)), 12) AS score FROM x JOIN idf USING (term) LEFT JOIN v ON v.k = x.k AND v.term = x.term GROUP BY ALL),
sx AS (SELECT path, list_transform(list_transform(regexp_extract_all(text, '{licenses.SPDX}', 1), lambda x: replace(replace(regexp_replace(x, '[ \t]+', ' ', 'g'), '( ', '('), ' )', ')')),
  lambda x: regexp_replace(CASE WHEN length(replace(x, '(', '')) = length(replace(x, ')', '')) THEN x ELSE translate(x, '()', '') END, '^\(([^()]*)\)$', '\1')) AS e FROM f WHERE contains(text, 'SPDX-License-Identifier:')),
sy AS (SELECT path, list_filter(e, lambda x: len(list_filter(string_split(translate(x, '()', ''), ' '), lambda y: NOT (y IN ('AND', 'OR', 'WITH') OR lower(y) IN ({_KNOWN_LIST}) OR starts_with(y, 'LicenseRef-')))) = 0) AS e FROM sx),
sz AS (SELECT path, list_filter(e, lambda x, i: list_position(e, x) = i) AS e FROM sy),
said AS (SELECT path, array_to_string(list_transform(e, lambda x: CASE WHEN len(e) > 1 AND contains(x, ' OR ') THEN '(' || x || ')' ELSE x END), ' AND ') AS name FROM sz),
a AS (SELECT path, score, k, pos, name, CASE WHEN t.size >= {licenses.BODY} THEN s.size / len(w) ELSE 0 END AS share FROM s JOIN t USING (k) JOIN f USING (path) WHERE score >= 0.75
  UNION ALL SELECT path, 1, -1, 0, name, 0 FROM said WHERE name <> ''),
own AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, k, pos) AS r FROM a) WHERE r = 1),
g AS (SELECT regexp_replace(path, '/[^/]*$', '') AS dir, arg_min(name, (-score, path)) AS granted FROM own JOIN f USING (path) WHERE named OR share >= 0.5 GROUP BY 1),
up AS (SELECT path, array_to_string(parts[1 : d], '/') AS dir, d FROM (SELECT path, string_split(path, '/') AS parts, unnest(range(1, len(string_split(path, '/')))) AS d FROM f)),
near AS (SELECT path, arg_max((granted, dir), d) AS n FROM up JOIN g USING (dir) GROUP BY 1)
SELECT doc_id, f.path, own.name AS own_license, round(own.score, 6) AS own_score, coalesce(own.name, n[1]) AS license, CASE WHEN own.name IS NULL THEN n[2] END AS license_dir
FROM f LEFT JOIN own USING (path) LEFT JOIN near USING (path)
""",
    "op4_sentence_spans": r"""
WITH cut AS (
  SELECT doc_id, list_filter(list_transform(string_split(
    regexp_replace(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), '\n\s*', chr(1), 'g'), chr(1)),
    lambda x: list_filter(regexp_split_to_array(lower(x), '\s+'), lambda w: w <> '')), lambda x: len(x) > 0) AS s
  FROM documents WHERE doc_id IS NOT NULL
), n AS (SELECT doc_id, unnest(range(1, len(s) + 1)) AS i, unnest(list_transform(s, lambda x: len(x))) AS n, unnest(list_transform(s, lambda x: array_to_string(x, ' '))) AS t FROM cut),
-- all runs: equal sentences in a row at an earlier and at a later place, as far as they go
p AS (SELECT a.doc_id AS d1, b.doc_id AS d2, b.i - a.i AS shift, b.i, b.n FROM n a JOIN n b ON a.t = b.t AND (a.doc_id, a.i) < (b.doc_id, b.i)),
g AS (SELECT *, i - row_number() OVER (PARTITION BY d1, d2, shift ORDER BY i) AS island FROM p),
blocks AS (SELECT d2 AS doc_id, min(i) AS lo, max(i) AS hi FROM g GROUP BY d1, d2, shift, island HAVING count(*) >= 2 AND sum(n) >= 20),
gone AS (SELECT DISTINCT doc_id, unnest(range(lo, hi + 1)) AS i FROM blocks),
-- first occurrences: of the runs that hold no shorter run
c AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS total FROM n),
r AS (
  SELECT a.doc_id, a.i, min(b.i) AS j FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i > a.i AND b.total - a.total + a.n >= 20 GROUP BY 1, 2
  UNION SELECT b.doc_id, max(a.i), b.i FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i > a.i AND b.total - a.total + a.n >= 20 GROUP BY b.doc_id, b.i
), k AS (SELECT r.*, array_to_string(list_transform(s[i : j], lambda x: array_to_string(x, ' ')), chr(1)) AS key FROM r JOIN cut USING (doc_id)),
o AS (SELECT *, min((doc_id, i)) OVER (PARTITION BY key) AS first FROM k),
firsts AS (SELECT doc_id, list_sort(list_distinct(list(first[1]))) AS first_doc_ids FROM o WHERE (doc_id, i) <> first GROUP BY 1),
words AS (
  SELECT n.doc_id, coalesce(string_agg(n.t, ' ' ORDER BY n.i) FILTER (gone.i IS NULL), '') AS kept,
    count(*) AS n_sentences, count(gone.i) AS n_removed
  FROM n LEFT JOIN gone ON gone.doc_id = n.doc_id AND gone.i = n.i GROUP BY 1
)
SELECT doc_id, CAST(n_sentences AS INTEGER) AS n_sentences, CAST(n_removed AS INTEGER) AS n_removed, CAST(length(kept) AS BIGINT) AS kept_chars,
  sha256(kept) AS kept_sha256, unnest(first_doc_ids) AS first_doc_id
FROM words JOIN firsts USING (doc_id)
""",
    "op3_bbit_minhash": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS s
  FROM w
), e AS (SELECT doc_id, unnest(s) AS x FROM s),
pairs AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT u, v FROM pairs JOIN s a ON a.doc_id = u JOIN s b ON b.doc_id = v
  WHERE 100 * shared >= 80 * (len(a.s) + len(b.s) - shared)
), reach AS (
  SELECT doc_id AS id, doc_id AS other FROM documents
  UNION SELECT reach.id, links.v FROM reach JOIN links ON links.u = reach.other
), least AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
SELECT doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM s JOIN least ON least.id = s.doc_id
""",
    "op6_exact_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 10
""",
    "op7_templates": rf"""
WITH src AS (
  SELECT 'd' AS side, doc_id AS id, string_split(text, chr(10)) AS l FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
  UNION ALL SELECT 'b', item_id, string_split(text, chr(10)) FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), ln AS (SELECT side, id, unnest(range(1, len(l) + 1)) AS ln, unnest(l) AS line FROM src),
ws AS (SELECT side, id, ln, list_filter(regexp_split_to_array(line, '\s+'), lambda x: x <> '') AS w FROM ln),
wd AS (SELECT side, id, ln, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS word FROM ws),
co AS (SELECT side, id, k, word, row_number() OVER (PARTITION BY side, id ORDER BY ln, k) AS p, trim(word, '{_STRIPPED}') AS core FROM wd),
fl AS (SELECT side, id, k, p, lower(core) AS plain, regexp_matches(core, '[0-9]') AS num,
  core <> '' AND core[1] = upper(core[1]) AND core[1] <> lower(core[1]) AND core <> upper(core) AND NOT regexp_matches(core, '[0-9]') AS cap,
  lower(core) IN ({_UNIT_LIST}) AS uni, rtrim(word, '{_CLOSING}')[-1] IN ('.', '!', '?', ':') AS fin FROM co),
lg AS (SELECT *, k = 1 OR lag(fin) OVER o AS opens, coalesce(lag(num) OVER o, false) AS behind FROM fl WINDOW o AS (PARTITION BY side, id ORDER BY p)),
cd AS (SELECT *, CASE WHEN num THEN '#N' WHEN uni AND behind THEN '#U' WHEN cap AND NOT opens THEN '#A' ELSE plain END AS code,
  num OR (uni AND behind) OR (cap AND NOT opens) AS slot FROM lg),
ag AS (SELECT side, id, list(code ORDER BY p) AS c, list(plain ORDER BY p) AS v, list(slot ORDER BY p) AS s, count(*) AS n FROM cd GROUP BY 1, 2),
sz AS (SELECT DISTINCT least(n, 5) AS size FROM ag WHERE side = 'b'),
wi AS (SELECT side, id, size, unnest(list_transform(range(1, n - size + 2), lambda i: {{'pos': i, 'v': v[i : i + size - 1], 's': s[i : i + size - 1], 'c': array_to_string(c[i : i + size - 1], chr(1))}})) AS x
  FROM ag JOIN sz ON CASE side WHEN 'b' THEN size = least(n, 5) ELSE n >= size END),
inf AS (SELECT side, id, x.pos AS pos, x.v AS v, x.s AS s,
  CASE WHEN len(list_filter(x.s, lambda y: NOT y)) >= least(2, size) THEN size || ':' || x.c ELSE size || '=' || array_to_string(x.v, chr(1)) END AS key FROM wi),
tot AS (SELECT id AS item_id, count(DISTINCT pos) AS windows FROM inf WHERE side = 'b' GROUP BY 1),
hit AS (SELECT d.id AS doc_id, b.id AS item_id, d.pos - b.pos AS shift, b.pos, b.v AS ours, d.v AS theirs, b.s FROM inf d JOIN inf b ON d.key = b.key AND d.side = 'd' AND b.side = 'b'),
pr AS (SELECT DISTINCT doc_id, item_id, shift, a, z FROM (SELECT doc_id, item_id, shift, unnest(ours) AS a, unnest(theirs) AS z, unnest(s) AS slot FROM hit) WHERE slot),
st AS (SELECT doc_id, item_id, shift, count(*) = count(DISTINCT a) AS single, bool_and(a = z) AS same FROM pr GROUP BY 1, 2, 3),
ok AS (SELECT hit.*, coalesce(same, true) AS same FROM hit LEFT JOIN st USING (doc_id, item_id, shift) WHERE coalesce(single, true)),
fin AS (SELECT doc_id, item_id, count(DISTINCT pos) AS matched, bool_and(same) AS same FROM ok GROUP BY 1, 2)
SELECT doc_id, item_id, windows, matched, matched / windows AS cover, CASE WHEN same THEN 'verbatim' ELSE 'reworded' END AS kind
FROM fin JOIN tot USING (item_id) WHERE matched >= 0.8 * windows
""",
    "op8_warc": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex,
    min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
  FROM pages
), d AS (
  SELECT *, list_transform(range(0, 160, 5), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + CAST((CAST('0x' || substr(hex || '0', i // 4 + 1, 3) AS INTEGER) // CAST(pow(2, 7 - i % 4) AS INTEGER)) % 32 AS INTEGER), 1)) AS letters
  FROM p
)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, array_to_string(letters, '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
""",
    "op9_chat_formatting": r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *,
    length(text) + length(text) - length(replace(text, '\', ''))
      + len(regexp_extract_all(text, '</?s>|\[/?(INST|SYS|ROLE)\]')) AS own,
    CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 13 WHEN 'assistant' THEN 0
      ELSE 13 + length(role) + length(role) - length(replace(role, '\', ''))
        + len(regexp_extract_all(role, '</?s>|\[/?(INST|SYS|ROLE)\]')) END AS around,
    row_number() OVER (PARTITION BY conv_id, alone ORDER BY turn NULLS FIRST, role, text) - 1 AS k,
    lag(role) OVER (PARTITION BY conv_id, alone ORDER BY turn NULLS FIRST, role, text) AS before
  FROM (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM rows)
), judged AS (
  SELECT *, CASE
    WHEN k = 0 THEN role IN ('system', 'user')
    WHEN role = 'user' THEN before = 'assistant' OR (before = 'system' AND k = 1)
    WHEN role = 'assistant' THEN before = 'user'
    ELSE false END AS fine
  FROM sized
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(own + around + 7) AS BIGINT) AS formatted_chars,
  bool_and(fine) AND max_by(role, k) = 'assistant' AS valid,
  CAST(min(k) FILTER (NOT fine) AS BIGINT) AS bad_turn
FROM judged GROUP BY conv_id, alone
""",
    "op11_phrases": r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM t),
g AS (SELECT lang, 1 AS m, unnest(w) AS phrase FROM w
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM w),
f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY 1),
c AS (SELECT lang, m, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE m > 1 AND f >= 10),
k AS (SELECT *, array_to_string(w[1 : k], ' ') AS head, array_to_string(w[k + 1 :], ' ') AS tail FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
s AS (SELECT k.lang, k.phrase, a, k, x.f AS l, y.f AS r, 1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f) AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.phrase = head JOIN f y ON y.lang = k.lang AND y.phrase = tail),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM s) WHERE o = 1),
i AS (SELECT lang, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase, a FROM c WHERE m = 3),
d AS (SELECT lang, phrase, max(a) AS a FROM i GROUP BY 1, 2),
o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) AS rank FROM b LEFT JOIN d USING (lang, phrase) WHERE d.a IS NULL OR 100 * d.a < 50 * b.a)
SELECT lang, CAST(rank AS INTEGER) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM o JOIN n USING (lang) WHERE rank <= 2000
""",
    "op12_vector_codes": f"""
WITH e AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS i, vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT i, p, e[p * len(e) // 4 + 1 : (p + 1) * len(e) // 4] AS x FROM e, (SELECT unnest(range(4)) AS p)),
c0 AS (SELECT p, i - 1 AS idx, x FROM v WHERE i <= 256),{_code_rounds()},
q AS (SELECT i, string_agg(printf('%02x', best[1]), '' ORDER BY p) AS code, CAST(sum(best[2]) AS BIGINT) AS error FROM a4 GROUP BY 1),
h AS (SELECT sha256(string_agg(array_to_string(list_transform(x, lambda y: CAST(CAST(y AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY p, idx)) AS codebooks_sha256 FROM c4)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM q JOIN e USING (i), h
""",
    "op13_line_dedup": r"""
WITH l AS (SELECT d, doc_id, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS line FROM (SELECT row_number() OVER () AS d, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT d, k.doc_id, pos, line, coalesce(top <> k.doc_id, false) AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY d, doc_id
""",
}
