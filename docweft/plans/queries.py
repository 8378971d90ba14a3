"""Queries over the data tables that exercise the operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.functions import text as T
from docweft.functions.shared import dealt, each, fresh_dir
from docweft.operators import aggregates, assemble, contracts, extract, incremental, models, postprocess, store, tensors, vision
from docweft.plans import engine
from docweft.schema import FieldSpec, SchemaSpec
from docweft.sources import docx, images, ingest, ocr

FIELDS = f"array<struct<key:string,value_json:string,items:array<string>,meaningful:boolean,confidence:float,evidences:array<{extract.EVIDENCE}>>>"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rendered(rows: DataFrame, key: Column, *texts: Column, one_block: bool = True) -> DataFrame:
    """Rows as text documents: one page with one block, or with a block for each text."""
    blocks = F.array(F.array_join(F.array(*texts), "\n")) if one_block else F.array(*texts)
    held = rows.select(key.cast("string").alias("key"), blocks.alias("texts"))
    pages = assemble.pages_from_texts(F.col("key"), F.array("texts"), "native_text")
    return assemble.documents(held, F.col("key"), F.lit("text"), pages, F.lit(None).cast("string"), F.lit("text/plain"), {"parser_provider": F.lit("text-parser")})


def line(label: str, value: Column) -> Column:
    return F.concat(F.lit(label + ": "), value.cast("string"))


def results(docs: DataFrame, *fields: FieldSpec, evidence: bool = True) -> DataFrame:
    return postprocess.finalize(extract.extract(docs, SchemaSpec("query", "1", fields), evidence))


def field(k: int) -> Column:
    return F.col("fields")[k]


def plain_string(json: Column) -> Column:
    return F.get_json_object(F.concat(F.lit('{"v":'), json, F.lit("}")), "$.v")


# ---- extraction ----


@query(
    "extract_scalar",
    """SELECT c_custkey, c_mktsegment AS segment, c_name AS name, round(CAST(CAST(0.55 AS REAL) + CAST(0.2 AS REAL) + CAST(0.05 AS REAL) AS DOUBLE), 4) AS confidence,
  CAST(1 AS BIGINT) AS n_evidence FROM customer""",
)
def extract_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    docs = rendered(rows, F.col("c_custkey"), line("name", F.col("c_name")), line("segment", F.col("c_mktsegment")), line("balance", F.col("c_acctbal")))
    out = results(docs, FieldSpec("segment", required=True), FieldSpec("name"))
    return out.select(
        F.col("doc_id").cast("long").alias("c_custkey"),
        plain_string(field(0)["value_json"]).alias("segment"),
        plain_string(field(1)["value_json"]).alias("name"),
        F.round(field(0)["confidence"].cast("double"), 4).alias("confidence"),
        F.size(field(0)["evidences"]).cast("long").alias("n_evidence"),
    )


@query("extract_number", "SELECT p_partkey, CAST(p_size AS BIGINT) AS size, round(p_retailprice, 2) AS price FROM part")
def extract_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rendered(table(spark, sf_dir, "part"), F.col("p_partkey"), F.concat(F.lit("- size："), F.col("p_size").cast("string"), F.lit(" cm")), line("price", F.col("p_retailprice")))
    out = results(docs, FieldSpec("size", "number"), FieldSpec("price", "number"), evidence=False)
    return out.select(
        F.col("doc_id").cast("long").alias("p_partkey"), field(0)["value_json"].cast("long").alias("size"), F.round(field(1)["value_json"].cast("double"), 2).alias("price")
    )


@query(
    "extract_boolean",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, CASE l_returnflag WHEN 'R' THEN true WHEN 'A' THEN false END AS returned FROM lineitem",
)
def extract_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    key = F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    word = F.when(F.col("l_returnflag") == "R", "是").when(F.col("l_returnflag") == "A", "No").otherwise("perhaps")
    out = results(rendered(rows, key, line("returned", word)), FieldSpec("returned", "boolean"), evidence=False)
    part = F.split("doc_id", r"\|")
    return out.select(
        part[0].cast("long").alias("l_orderkey"),
        part[1].cast("int").alias("l_linenumber"),
        part[2].cast("long").alias("l_partkey"),
        part[3].cast("double").alias("l_quantity"),
        F.nullif(field(0)["value_json"], F.lit("null")).cast("boolean").alias("returned"),
    )


@query("extract_hints", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'key wins' ELSE c_mktsegment END AS segment FROM customer")
def extract_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("c_custkey") % 2 == 1, "market").otherwise("segment")
    third = F.when(F.col("c_custkey") % 3 == 0, "\nsegment: key wins").otherwise("")
    own = F.when((F.col("c_custkey") % 3 == 0) & (F.col("c_custkey") % 2 == 0), F.lit("other: x")).otherwise(F.concat(label, F.lit(": "), F.col("c_mktsegment")))
    docs = rendered(table(spark, sf_dir, "customer"), F.col("c_custkey"), F.concat(own, third))
    out = results(docs, FieldSpec("segment", hints=("market",)), evidence=False)
    return out.select(F.col("doc_id").cast("long").alias("c_custkey"), plain_string(field(0)["value_json"]).alias("segment"))


def _order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    # many expressions over few bytes: a stated number of partitions isn't merged by size, and both sides keep it through the join
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    items = table(spark, sf_dir, "lineitem").repartition(parts, "l_orderkey").groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", "l_returnflag"))).alias("lines")
    )
    return table(spark, sf_dir, "orders").repartition(parts, "o_orderkey").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn(
        "lines", F.coalesce("lines", F.array().cast("array<struct<l_linenumber:int,l_partkey:bigint,l_quantity:double,l_returnflag:string>>"))
    )


@query(
    "extract_multiple",
    """WITH l AS (SELECT l_orderkey, l_returnflag, min((l_linenumber, l_partkey, l_quantity)) AS first FROM lineitem GROUP BY 1, 2)
SELECT o_orderkey, coalesce((SELECT string_agg(l_returnflag, '|' ORDER BY first) FROM l WHERE l_orderkey = o_orderkey), '') AS flags FROM orders""",
)
def extract_multiple(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.array_join(F.transform("lines", lambda x: F.concat(F.lit("flag: "), x["l_returnflag"])), "\n")
    out = results(rendered(_order_lines(spark, sf_dir), F.col("o_orderkey"), line("order", F.col("o_orderkey")), lines), FieldSpec("flag", multiple=True), evidence=False)
    return out.select(F.col("doc_id").cast("long").alias("o_orderkey"), F.array_join(F.transform(field(0)["items"], plain_string), "|").alias("flags"))


@query(
    "extract_rows",
    """WITH d AS (SELECT l_orderkey, l_partkey, min((l_linenumber, l_quantity)) AS first FROM lineitem GROUP BY 1, 2),
l AS (SELECT l_orderkey, string_agg('{"part":' || l_partkey || '}', '|' ORDER BY (first[1], l_partkey, first[2])) AS t, count(*) AS n FROM d GROUP BY 1)
SELECT o_orderkey, coalesce(t, '') AS rows, coalesce(n, 0) AS n_rows FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""",
)
def extract_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.array_join(F.transform("lines", lambda x: F.concat(F.lit("* part: "), x["l_partkey"].cast("string"))), "\n")
    spec = FieldSpec("lines", "array", children=(FieldSpec("part", "number", multiple=True),))
    out = results(rendered(_order_lines(spark, sf_dir), F.col("o_orderkey"), lines), spec)
    return out.select(F.col("doc_id").cast("long").alias("o_orderkey"), F.array_join(field(0)["items"], "|").alias("rows"), F.size(field(0)["items"]).cast("long").alias("n_rows"))


@query(
    "extract_object",
    """SELECT s_suppkey, '{"name":"' || s_name || '","nation":' || s_nationkey || ',"fax":null}' AS supplier,
  round(CAST(CAST(CAST(CAST(0.8 AS REAL) + CAST(0.75 AS REAL) AS REAL) + CAST(0.2 AS REAL) AS REAL) / CAST(2 AS REAL) AS DOUBLE), 4) AS confidence FROM supplier""",
)
def extract_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rendered(table(spark, sf_dir, "supplier"), F.col("s_suppkey"), line("name", F.col("s_name")), line("nation", F.col("s_nationkey")))
    spec = FieldSpec("supplier", "object", children=(FieldSpec("name", required=True), FieldSpec("nation", "number"), FieldSpec("fax")))
    out = results(docs, spec)
    return out.select(F.col("doc_id").cast("long").alias("s_suppkey"), field(0)["value_json"].alias("supplier"), F.round(field(0)["confidence"].cast("double"), 4).alias("confidence"))


@query(
    "confidence_rules",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 0.8 ELSE 0.05 END::DOUBLE AS needed, CASE WHEN o_orderkey % 2 = 0 THEN 0.75 ELSE 0.1 END::DOUBLE AS optional,
  CASE WHEN o_orderkey % 2 = 0 THEN 0.8 ELSE 0.75 END::DOUBLE AS several FROM orders""",
)
def confidence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.when(F.col("o_orderkey") % 2 == 0, F.concat(line("status", F.col("o_orderstatus")), F.lit("\nn: 1\nn: 2"))).otherwise(F.lit("n: 1"))
    out = results(rendered(table(spark, sf_dir, "orders"), F.col("o_orderkey"), own), FieldSpec("status", required=True), FieldSpec("status2", hints=("status",)), FieldSpec("n", "number", multiple=True))
    names = ("needed", "optional", "several")
    return out.select(F.col("doc_id").cast("long").alias("o_orderkey"), *(F.round(field(i)["confidence"].cast("double"), 4).alias(n) for i, n in enumerate(names)))


@query(
    "evidence_binding",
    """SELECT c_custkey, CAST(2 + CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_evidence, 'name: ' || c_name AS first_text FROM customer""",
)
def evidence_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    again = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("the name is "), F.col("c_name"))).otherwise("nothing")
    docs = rendered(table(spark, sf_dir, "customer"), F.col("c_custkey"), line("name", F.col("c_name")), again, F.concat(F.lit("see also: name "), F.col("c_name")), one_block=False)
    out = results(docs, FieldSpec("name"))
    return out.select(F.col("doc_id").cast("long").alias("c_custkey"), F.size(field(0)["evidences"]).cast("long").alias("n_evidence"), field(0)["evidences"][0]["text"].alias("first_text"))


@query(
    "postprocess_values",
    """WITH l AS (SELECT conv_id, trim(text) AS t, min(turn) AS first FROM conversations WHERE trim(text) <> '' GROUP BY 1, 2)
SELECT conv_id, sha256(string_agg(t, '|' ORDER BY first)) AS kept, count(*) AS n FROM l GROUP BY 1""",
)
def postprocess_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    twice = F.sort_array(F.collect_list(F.struct("turn", "text")))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(twice.alias("t"))
    texts = F.flatten(F.transform("t", lambda x: F.array(F.concat(F.lit(" "), x["text"], F.lit(" ")), F.lit("  "), x["text"])))
    kept = postprocess.normalize_strings(texts)
    return rows.select("conv_id", F.sha2(F.encode(F.array_join(kept, "|"), "UTF-8"), 256).alias("kept"), F.size(kept).cast("long").alias("n"))


# ---- sources and routing ----


@query("html_passthrough", "SELECT page_id, CAST(length(trim(html)) AS BIGINT) AS chars, sha256(trim(html)) AS digest, CAST(1 AS BIGINT) AS n_blocks FROM pages")
def html_passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select(
        F.col("page_id").cast("string").alias("doc_id"), F.lit("html").alias("source_type"), F.col("html").alias("text"), "url", F.lit(None).cast("string").alias("file_name"), F.lit("text/html").alias("mime_type")
    )
    docs = ingest.read_inline(rows)
    return docs.select(
        F.col("doc_id").cast("long").alias("page_id"),
        F.length("plain_text").cast("long").alias("chars"),
        F.sha2(F.encode("plain_text", "UTF-8"), 256).alias("digest"),
        F.size(assemble.blocks_of(F.col("pages"))).cast("long").alias("n_blocks"),
    )


@query("url_placeholder", "SELECT page_id, 'url ingestion placeholder: ' || url AS text FROM pages")
def url_placeholder(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("doc_id"), F.lit("url").alias("source_type"), none.alias("text"), "url", none.alias("file_name"), none.alias("mime_type"))
    return ingest.read_inline(rows).select(F.col("doc_id").cast("long").alias("page_id"), F.col("plain_text").alias("text"))


@query(
    "detect_type",
    """WITH d AS (SELECT doc_id, [NULL, 'image/PNG', 'application/pdf', 'application/vnd.wordprocessingml.document', 'TEXT/HTML', 'text/x-markdown', 'text/csv', 'application/zip'][1 + doc_id % 8] AS mime,
  ['a.PDF', 'b.docx', 'c.htm', 'd.markdown', 'e.txt', 'f.WebP', 'g.gif', 'noending', 'x.tar.jpeg'][1 + doc_id % 9] AS name FROM documents),
n AS (SELECT *, lower(mime) AS m, CASE WHEN contains(name, '.') THEN lower(split_part(name, '.', -1)) END AS e FROM d)
SELECT doc_id, CASE WHEN m LIKE 'image/%' THEN 'image' WHEN m = 'application/pdf' THEN 'pdf' WHEN contains(m, 'wordprocessingml') THEN 'docx' WHEN m = 'text/html' THEN 'html'
  WHEN m IN ('text/markdown', 'text/x-markdown') THEN 'markdown' WHEN m LIKE 'text/%' THEN 'text' WHEN e = 'pdf' THEN 'pdf' WHEN e = 'docx' THEN 'docx' WHEN e IN ('htm', 'html') THEN 'html'
  WHEN e IN ('md', 'markdown') THEN 'markdown' WHEN e = 'txt' THEN 'text' WHEN e IN ('png', 'jpg', 'jpeg', 'webp', 'bmp') THEN 'image' ELSE 'unknown' END AS source_type FROM n""",
)
def detect_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    mimes = [None, "image/PNG", "application/pdf", "application/vnd.wordprocessingml.document", "TEXT/HTML", "text/x-markdown", "text/csv", "application/zip"]
    names = ["a.PDF", "b.docx", "c.htm", "d.markdown", "e.txt", "f.WebP", "g.gif", "noending", "x.tar.jpeg"]
    pick = lambda values, n: F.get(F.array(*(F.lit(v).cast("string") for v in values)), (F.col("doc_id") % n).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", ingest.source_type(pick(names, 9), pick(mimes, 8)).alias("source_type"))


@query(
    "input_errors",
    """SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN CASE WHEN conv_id % 2 = 0 THEN 'content is required' END WHEN 1 THEN CASE WHEN conv_id % 2 = 0 THEN 'url is required' END
  WHEN 2 THEN 'bytes are required' ELSE 'unknown kind' END AS error FROM conversations""",
)
def input_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.get(F.array(*(F.lit(k) for k in ("html", "url", "pdf", "spreadsheet"))), (F.col("turn") % 4).cast("int"))
    given = F.when(F.col("conv_id") % 2 == 0, F.lit(" 　\n")).otherwise(F.lit("x"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", ingest.input_error(kind, given, given).alias("error"))


@query("placeholder_text", "SELECT page_id, 'summary' || chr(10) || 'file_name: ' || CASE WHEN page_id % 2 = 0 THEN 'p' || page_id ELSE 'unnamed' END || chr(10) || 'mime_type: unknown' || chr(10) || 'byte_size: ' || octet_length(encode(html)) AS text FROM pages")
def placeholder_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("p"), F.col("page_id").cast("string")))
    return table(spark, sf_dir, "pages").select("page_id", ingest.placeholder(F.lit("summary"), name, F.lit(None).cast("string"), F.octet_length("html")).alias("text"))


@query(
    "line_blocks",
    """WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents)
SELECT doc_id, CAST(len(l) AS BIGINT) AS n_blocks, sha256(array_to_string(l, chr(10))) AS digest, CAST(length(l[1]) AS BIGINT) AS first_chars FROM l""",
)
def line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    pages = assemble.pages_from_texts(F.col("doc_id").cast("string"), F.array(T.nonblank_lines(F.col("text"))), "synthetic")
    blocks = assemble.blocks_of(F.col("pages"))
    return rows.select("doc_id", pages.alias("pages")).select(
        "doc_id", F.size(blocks).cast("long").alias("n_blocks"), F.sha2(F.encode(assemble.plain_text(F.col("pages")), "UTF-8"), 256).alias("digest"), F.length(F.get(blocks, 0)["text"]).cast("long").alias("first_chars")
    )


@query(
    "docx_paragraphs",
    """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
SELECT doc_id, CAST(len(l) + 1 AS BIGINT) AS n_paragraphs, CAST(len(l) AS BIGINT) AS n_texts, sha256(array_to_string(l, chr(10))) AS digest FROM l""",
)
def docx_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    def encoded(c: Column) -> Column:
        return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))

    runs = F.transform(
        F.split("text", "\n", -1),
        lambda t: F.concat(F.lit("<w:p><w:tab/><w:r><w:t>"), encoded(F.substring(t, 1, 5)), F.lit('</w:t></w:r><w:r><w:t xml:space="preserve">'), encoded(F.substring(t, F.lit(6), F.length(t))), F.lit("</w:t></w:r></w:p>")),
    )
    xml = F.concat(F.lit("<w:document><w:p></w:p>"), F.array_join(runs, ""), F.lit("</w:document>"))
    found = docx.paragraphs(F.col("xml"))
    return table(spark, sf_dir, "documents").select("doc_id", xml.alias("xml")).select(
        "doc_id", docx.paragraph_count(F.col("xml")).cast("long").alias("n_paragraphs"), F.size(found).cast("long").alias("n_texts"), F.sha2(F.encode(F.array_join(found, "\n"), "UTF-8"), 256).alias("digest")
    )


@query(
    "xml_entities",
    """SELECT page_id, sha256(replace(replace(replace(replace(replace(html, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', '''')) AS digest FROM pages""",
)
def xml_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(F.encode(T.xml_entities(F.col("html")), "UTF-8"), 256).alias("digest"))


@query(
    "ocr_flatten",
    """SELECT conv_id, turn + 1 AS page_no, 'ocr-p' || (turn + 1) || '-b1' AS block_id, trim(string_split(text, chr(10))[1]) AS first_line,
  CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines FROM conversations WHERE len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) > 0""",
)
def ocr_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.transform(F.split("text", "\n", -1), lambda t: F.struct(F.concat(F.lit(" "), t).alias("text"), F.lit(0.5).alias("confidence")))
    page = F.struct((F.col("turn") + 1).cast("int").alias("page_no"), F.array(F.struct(F.lit(" ").alias("text"), lines.alias("lines"))).alias("blocks"))
    answers = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.to_json(F.struct(F.sort_array(F.collect_list(page)).alias("pages"))).alias("answer"))
    parsed = ocr.parse_answers(answers)
    return parsed.select("conv_id", each("blocks").alias("b")).where("b is not null").select(
        "conv_id", F.col("b.page_no").cast("long").alias("page_no"), "b.block_id", F.split("b.text", "\n")[0].alias("first_line"), F.col("b.line_count").cast("long").alias("n_lines")
    )


# ---- documents, pages and events ----


@query(
    "page_prefix",
    """SELECT conv_id, turn, CAST(sum(length(trim(text)) + 1) OVER w - 1 AS BIGINT) AS chars, sha256(string_agg(trim(text), chr(10)) OVER w) AS digest
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)""",
)
def page_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assemble.page_prefixes(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")
    return out.select("conv_id", "turn", F.length("prefix_text").cast("long").alias("chars"), F.sha2(F.encode("prefix_text", "UTF-8"), 256).alias("digest"))


@query(
    "delta_revisions",
    """WITH m AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id, event_id % 3 ORDER BY ts) AS previous,
  row_number() OVER (PARTITION BY user_id, event_id % 3 ORDER BY ts) AS n FROM events)
SELECT user_id, event_id, event_type, previous, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id % 3) AS INTEGER) AS revision
FROM m WHERE n = 1 OR event_type IS DISTINCT FROM previous""",
)
def delta_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("k", F.col("event_id") % 3)
    return incremental.changes(rows, ["user_id"], "k", ["ts"], "event_type").select("user_id", "event_id", "event_type", "previous", "revision")


@query("event_sequence", "SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS sequence FROM events")
def event_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.numbered(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "sequence")


@query("cache_hits", "SELECT doc_id, CAST(row_number() OVER (PARTITION BY text ORDER BY doc_id) - 1 AS INTEGER) AS hit_count FROM documents")
def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", store.cache_key(F.col("text"), F.lit("schema"), F.lit(None).cast("string")).alias("key"))
    return store.lookups(rows, "key", ["doc_id"]).select("doc_id", "hit_count")


@query(
    "cache_split",
    """WITH c AS (SELECT DISTINCT left(text, 12) AS head FROM conversations WHERE role = 'user') SELECT doc_id, left(text, 3) IN (SELECT left(head, 3) FROM c) AS cached FROM documents""",
)
def cache_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against a cache of the beginnings of user turns."""
    rows = table(spark, sf_dir, "documents").select("doc_id", store.cache_key(F.substring("text", 1, 3)).alias("key"))
    cache = table(spark, sf_dir, "conversations").where("role = 'user'").select(store.cache_key(F.substring("text", 1, 3)).alias("key")).distinct()
    hits, misses = store.split_by_cache(rows, cache, "key")
    return hits.select("doc_id", F.lit(True).alias("cached")).unionByName(misses.select("doc_id", F.lit(False).alias("cached")))


@query(
    "latest_task_state",
    "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1",
)
def latest_task_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.latest(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query(
    "task_status",
    """WITH t AS (SELECT user_id AS task_id, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY 1)
SELECT c_custkey AS task_id, coalesce(status, 'not_found') AS status FROM customer LEFT JOIN t ON task_id = c_custkey""",
)
def task_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = store.latest(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"]).select(F.col("user_id").alias("task_id"), F.col("event_type").alias("status"))
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("task_id"))
    return store.task_status(asked, tasks)


@query("unanimous_value", "SELECT o_custkey, CASE WHEN count(DISTINCT o_orderpriority) = 1 THEN max(o_orderpriority) END AS priority FROM orders GROUP BY 1")
def unanimous_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(aggregates.unanimous(F.col("o_orderpriority")).alias("priority"))


@query(
    "page_aggregates",
    """WITH f AS (SELECT user_id, event_type, min((ts, event_id)) AS first FROM events WHERE event_type <> 'error' GROUP BY 1, 2),
s AS (SELECT user_id, CAST(sum(nullif(event_id % 5, 0)) AS BIGINT) AS timing FROM events WHERE event_id % 7 = 0 GROUP BY 1)
SELECT user_id, string_agg(event_type, '|' ORDER BY first) AS warnings, any_value(timing) AS timing FROM f LEFT JOIN s USING (user_id) GROUP BY 1""",
)
def page_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") != "error", F.col("event_type"))
    timing = F.when(F.col("event_id") % 7 == 0, F.nullif(F.col("event_id") % 5, F.lit(0).cast("long")))
    out = rows.groupBy("user_id").agg(
        F.array_join(aggregates.first_distinct(kind, F.struct("ts", "event_id")), "|").alias("warnings"), F.sum(timing).alias("timing")
    )
    return out.where("warnings <> ''")


@query(
    "weighted_vote",
    """WITH s AS (SELECT user_id, (event_id % 4) * 90 AS rotation, sum(CAST(floor(value) AS BIGINT)) AS w FROM events WHERE floor(value) > 0 GROUP BY 1, 2)
SELECT user_id, rotation FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY w DESC, rotation DESC) AS n FROM s) WHERE n = 1""",
)
def weighted_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", ((F.col("event_id") % 4) * 90).alias("rotation"), F.floor("value").cast("double").alias("w"))
    return aggregates.weighted_vote(rows, "user_id", "rotation", "w").select("user_id", "rotation")


@query(
    "bbox_union",
    """SELECT l_orderkey, min(l_linenumber * 10.0::DOUBLE) AS x1, min(l_quantity) AS y1, max(l_linenumber * 10.0::DOUBLE + l_quantity) AS x2, max(l_quantity + 5) AS y2 FROM lineitem GROUP BY 1""",
)
def bbox_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("l_linenumber") * F.lit(10.0), F.col("l_quantity")
    box = aggregates.bbox_union(x, y, x + y, y + 5)
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(box.alias("b")).select("l_orderkey", "b.*")


@query(
    "page_slots",
    """WITH p AS (SELECT conv_id, 2 * turn + 1 AS page_no, text FROM conversations), t AS (SELECT conv_id, max(page_no) AS top FROM p GROUP BY 1),
s AS (SELECT conv_id, unnest(range(1, top + 1)) AS page_no FROM t)
SELECT s.conv_id, s.page_no, length(text) AS chars FROM s LEFT JOIN p USING (conv_id, page_no)""",
)
def page_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "conversations").select("conv_id", (2 * F.col("turn") + 1).alias("page_no"), "text")
    return assemble.page_slots(pages, ["conv_id"], "page_no").select("conv_id", "page_no", F.length("text").cast("long").alias("chars"))


@query(
    "range_join_topk",
    """WITH t AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, (event_id * 37 % 100) / 100.0::DOUBLE AS s, (event_id * 53 % 100) / 100.0::DOUBLE AS e FROM events),
p AS (SELECT a.user_id, a.i AS start_index, b.i AS end_index, sqrt(a.s * b.e) AS c FROM t a JOIN t b ON a.user_id = b.user_id AND b.i BETWEEN a.i AND a.i + 32 WHERE a.s >= 0.5 AND b.e >= 0.5)
SELECT user_id, CAST(start_index AS INTEGER) AS start_index, CAST(end_index AS INTEGER) AS end_index, CAST(rank AS INTEGER) AS rank, round(c, 9) AS confidence
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY c DESC, start_index, end_index) AS rank FROM p) WHERE rank <= 8""",
)
def range_join_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = incremental.numbered(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"]).select(
        "user_id", F.col("sequence").alias("i"), (F.col("event_id") * 37 % 100 / 100.0).alias("s"), (F.col("event_id") * 53 % 100 / 100.0).alias("e")
    )
    return aggregates.spans(tokens, "user_id", "i", "s", "e").withColumn("confidence", F.round("confidence", 9))


@query(
    "ctc_collapse",
    """WITH t AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events),
k AS (SELECT *, event_type IS DISTINCT FROM before AND event_type <> 'error' AS kept FROM t)
SELECT user_id, coalesce(string_agg(event_type, '' ORDER BY ts) FILTER (kept), '') AS text, CAST(count(*) FILTER (kept) AS BIGINT) AS n,
  round(coalesce(avg(event_id % 64 / 64.0::DOUBLE) FILTER (kept), 0), 9) AS confidence FROM k GROUP BY 1""",
)
def ctc_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("score", (F.col("event_id") % 64) / 64)
    out = aggregates.ctc_collapse(rows, "user_id", "ts", "event_type", "error", "score")
    return out.select("user_id", "text", F.col("tokens").alias("n"), F.round("confidence", 9).alias("confidence"))


@query(
    "token_windows",
    """WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(0, greatest(CAST(ceil((len(w) - 64) / 48.0) AS BIGINT), 0) + 1)) * 48 AS first FROM w)
SELECT doc_id, first, CAST(len(w[first + 1 : first + 64]) AS BIGINT) AS n, w[first + 1] AS token FROM s""",
)
def token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.filter(F.split("text", r"\s+", -1), lambda x: x != "")
    rows = table(spark, sf_dir, "documents").select("doc_id", words.alias("w")).withColumn("first", F.explode(aggregates.window_starts(F.size("w"), 64, 16)))
    return rows.select("doc_id", F.col("first").cast("long").alias("first"), F.size(F.slice("w", F.col("first") + 1, F.lit(64))).cast("long").alias("n"), F.get("w", F.col("first")).alias("token"))


@query(
    "validate_first_error",
    """SELECT conv_id, turn, CASE conv_id % 7 WHEN 0 THEN 'protocol_version or sdk_version is required' WHEN 1 THEN 'unsupported protocol_version' WHEN 2 THEN 'plain_text or blocks are required'
  WHEN 3 THEN 'page_no must be at least 1' WHEN 4 THEN 'page_no must be unique' WHEN 5 THEN 'block text is blank' END AS error FROM conversations""",
)
def validate_first_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("conv_id") % 7

    def page(number: Column, text: Column) -> Column:
        return F.struct(number.cast("int").alias("page_no"), F.array(F.struct(number.cast("int").alias("page_no"), text.alias("text"))).alias("blocks"))

    one, two = page(F.when(kind == 3, 0).otherwise(1), F.when(kind == 5, "  ").otherwise("text")), page(F.when(kind == 4, 1).otherwise(2), F.lit("more"))
    none = F.array().cast("array<struct<page_no:int,blocks:array<struct<page_no:int,text:string>>>>")
    pages = F.when(kind == 2, none).otherwise(F.array(one, two))
    error = assemble.first_error(F.when(kind == 0, F.lit(None)).when(kind == 1, "2").otherwise("1").cast("string"), F.lit(None).cast("string"), F.when(kind == 2, " ").otherwise(F.col("text")), pages)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", error.alias("error"))


@query(
    "preview",
    """WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1:5] AS l FROM documents)
SELECT doc_id, array_to_string(list_transform(l, lambda x: CASE WHEN length(x) > 80 THEN substr(x, 1, 80) || '...' ELSE x END), '|') AS preview FROM l""",
)
def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.slice(T.nonblank_lines(F.col("text")), F.lit(1), F.lit(5))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(first, lambda x: T.preview(x, 80)), "|").alias("preview"))


@query(
    "header_suffix",
    """SELECT p_partkey, nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(p_type || ' /' || p_brand || '_.x!'), '[_\\-. /]+', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g'), '') AS suffix FROM part""",
)
def header_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.header_suffix(F.concat("p_type", F.lit(" /"), "p_brand", F.lit("_.x!"))).alias("suffix"))


@query(
    "resize_dims",
    """WITH s AS (SELECT p_partkey, p_size * 100 AS w, p_size * 37 + 1 AS h FROM part), f AS (SELECT *, least(1.0::DOUBLE, 1536.0::DOUBLE / greatest(w, h)) AS f FROM s)
SELECT p_partkey, greatest(1, CAST(round(w * f) AS INTEGER)) AS width, greatest(1, CAST(round(h * f) AS INTEGER)) AS height FROM f""",
)
def resize_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", vision.resized(F.col("p_size") * 100, F.col("p_size") * 37 + 1).alias("d")).select("p_partkey", "d.*")


@query(
    "stage_events",
    """WITH d AS (SELECT conv_id AS task_id, count(*) AS n FROM conversations GROUP BY 1),
e AS (SELECT task_id, 0 AS place, 0 AS page, 'task.accepted' AS event_type, NULL AS stage FROM d UNION ALL SELECT task_id, 3, 0, 'stage.changed', 'parsing' FROM d
UNION ALL SELECT task_id, 4, 0, 'document.ready', NULL FROM d UNION ALL SELECT conv_id, 5, turn + 1, 'page.parsed', NULL FROM conversations UNION ALL SELECT task_id, 6, 0, 'stage.changed', 'extracting' FROM d
UNION ALL SELECT task_id, 8, 0, 'stage.changed', 'postprocessing' FROM d UNION ALL SELECT task_id, 9, 0, 'result.snapshot', NULL FROM d UNION ALL SELECT task_id, 10, 0, 'completed', NULL FROM d)
SELECT task_id, event_type, stage, CAST(row_number() OVER (PARTITION BY task_id ORDER BY place, page) AS INTEGER) AS sequence,
  CASE WHEN event_type = 'page.parsed' THEN page END AS page_no, CASE WHEN event_type = 'document.ready' THEN n END AS page_count,
  (SELECT CAST(length(trim(text)) AS BIGINT) FROM conversations WHERE conv_id = task_id AND turn = page - 1 AND event_type = 'page.parsed') AS text_chars FROM e JOIN d USING (task_id)""",
)
def stage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _conversation_documents(spark, sf_dir, lambda x: x["text"])
    rows = incremental.document_events(docs).unionByName(incremental.result_events(docs.select("doc_id", F.array().cast(FIELDS).alias("fields"), F.lit(None).cast("string").alias("raw_text"))))
    payload = lambda name: F.get_json_object("payload", f"$.{name}").cast("long").alias(name)
    return incremental.sequenced(rows).select(F.col("task_id").cast("long").alias("task_id"), "event_type", "stage", "sequence", payload("page_no"), payload("page_count"), payload("text_chars"))


def _conversation_documents(spark: SparkSession, sf_dir: str, text, height: float = 8.0) -> DataFrame:
    """Conversations as documents: a page for each turn with one block, ``text`` of the turn, in a box that depends on it."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))

    def page(x: Column, i: Column) -> Column:
        box = F.struct((x["turn"] * 10).cast("float").alias("x1"), F.lit(0.0).cast("float").alias("y1"), (x["turn"] * 10 + 5).cast("float").alias("x2"), F.lit(height).cast("float").alias("y2"))
        block = F.struct(
            F.concat(F.lit("b"), x["turn"].cast("string")).alias("block_id"), (i + 1).alias("page_no"), text(x).alias("text"), box.alias("bbox"), F.lit(None).cast("float").alias("confidence"), F.lit("native_text").alias("source_kind")
        )
        return F.struct((i + 1).alias("page_no"), F.lit(100.0).cast("float").alias("width"), F.lit(200.0).cast("float").alias("height"), F.array(block).alias("blocks"))

    docs = turns.select(F.col("conv_id").cast("string").alias("doc_id"), F.transform("t", page).cast(f"array<{assemble.PAGE}>").alias("pages"))
    none = F.lit(None).cast("string")
    meta = F.struct(none.alias("file_name"), none.alias("mime_type"), F.create_map().cast("map<string,string>").alias("extra"))
    return docs.select("doc_id", F.lit("text").alias("source_type"), "pages", assemble.plain_text(F.col("pages")).alias("plain_text"), meta.alias("metadata"))


@query(
    "number_parse",
    """WITH r AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'about 1,' || (o_orderkey % 900 + 100) || ' items' WHEN 1 THEN '-' || o_orderkey || '.50 EUR' WHEN 2 THEN 'none' ELSE '+' || o_orderkey END AS raw FROM orders)
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 1000.0 + o_orderkey % 900 + 100 WHEN 1 THEN -(o_orderkey + 0.5) WHEN 2 THEN NULL ELSE o_orderkey END::DOUBLE AS number FROM r""",
)
def number_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    raw = (
        F.when(k % 4 == 0, F.concat(F.lit("about 1,"), (k % 900 + 100).cast("string"), F.lit(" items")))
        .when(k % 4 == 1, F.concat(F.lit("-"), k.cast("string"), F.lit(".50 EUR")))
        .when(k % 4 == 2, "none")
        .otherwise(F.concat(F.lit("+"), k.cast("string")))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", T.number_json(raw).cast("double").alias("number"))


@query(
    "metadata_merge",
    """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'own' ELSE 'normalized' END AS ingest_mode, source AS source FROM documents""",
)
def metadata_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("source"), F.col("source"), F.lit("ingest_mode"), F.lit("own"))).otherwise(F.create_map(F.lit("source"), F.col("source")))
    merged = assemble.merge_extra(extra, {"ingest_mode": F.lit("normalized")})
    return table(spark, sf_dir, "documents").select("doc_id", merged.alias("m")).select("doc_id", F.col("m")["ingest_mode"].alias("ingest_mode"), F.col("m")["source"].alias("source"))


@query("orientation_votes", "SELECT event_id, CAST(CASE WHEN event_id % 4 >= 2 THEN 270 ELSE 180 END AS INTEGER) AS degrees FROM events")
def orientation_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = F.array(F.lit(0), F.lit(1), (F.col("event_id") % 4).cast("int") - 1 + F.when(F.col("event_id") % 4 < 2, 2).otherwise(0), F.when(F.col("event_id") % 4 >= 2, 9).otherwise(-1))
    return table(spark, sf_dir, "events").select("event_id", vision.orientation(F.transform(scores, lambda x: x.cast("double"))).cast("int").alias("degrees"))


# ---- incremental results, cache and failures ----


def _prefix_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = lambda x: F.concat(F.lit("role: "), x["role"], F.when(x["turn"] % 2 == 1, "\nodd: yes").otherwise(""))
    docs = _conversation_documents(spark, sf_dir, role)
    schema = SchemaSpec("q", "1", (FieldSpec("role", multiple=True), FieldSpec("odd", "boolean")))
    return incremental.partial_events(docs, engine.finalized_changes(extract.Matched(docs, schema, by_page=True), True), evidence=True)


_PREFIX_SQL = """WITH t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS page, count(*) OVER (PARTITION BY conv_id) AS pages, role FROM conversations),
f AS (SELECT conv_id, turn, page, pages, 0 AS n, 'role' AS key, true AS own FROM t UNION ALL SELECT conv_id, turn, page, pages, 1, 'odd', turn % 2 = 1 FROM t),
d AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY page, n) AS revision FROM f WHERE own OR page = 1),
e AS (SELECT d.*, (SELECT count(*) FROM f x WHERE x.conv_id = d.conv_id AND x.n = d.n AND x.page <= d.page AND x.own) AS evidences,
  (SELECT min(turn) FROM f x WHERE x.conv_id = d.conv_id AND x.n = d.n AND x.page <= d.page AND x.own) AS low, (SELECT max(turn) FROM f x WHERE x.conv_id = d.conv_id AND x.n = d.n AND x.page <= d.page AND x.own) AS high FROM d)"""


@query(
    "partial_events",
    _PREFIX_SQL
    + """, v AS (SELECT conv_id, page, (SELECT string_agg(role, ',' ORDER BY first) FROM (SELECT role, min(page) AS first FROM t x WHERE x.conv_id = t.conv_id AND x.page <= t.page GROUP BY 1)) AS roles FROM t)
SELECT conv_id, revision, key, page AS page_no, page AS pages_processed, pages AS page_count, evidences AS n_evidences,
  CASE WHEN key = 'role' THEN '["' || replace(roles, ',', '","') || '"]' WHEN evidences > 0 THEN 'true' ELSE 'null' END AS value, low * 10.0::DOUBLE AS x1, high * 10.0::DOUBLE + 5 AS x2 FROM e JOIN v USING (conv_id, page)""",
)
def partial_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _prefix_events(spark, sf_dir).where("event_type = 'result.partial'")
    kind = f"struct<revision:bigint,field:struct<key:string,value:string,evidences:array<{extract.EVIDENCE}>>,bbox:{assemble.BBOX},page_no:bigint,pages_processed:bigint,page_count:bigint>"
    p = F.col("p")
    return rows.select(F.col("task_id").cast("long").alias("conv_id"), F.from_json("payload", kind).alias("p")).select(
        "conv_id", p["revision"].alias("revision"), p["field"]["key"].alias("key"), p["page_no"].alias("page_no"), p["pages_processed"].alias("pages_processed"), p["page_count"].alias("page_count"),
        F.size(p["field"]["evidences"]).cast("long").alias("n_evidences"), F.coalesce(p["field"]["value"], F.lit("null")).alias("value"), p["bbox"]["x1"].cast("double").alias("x1"), p["bbox"]["x2"].cast("double").alias("x2"),
    )


@query(
    "block_events",
    _PREFIX_SQL + """ SELECT conv_id, revision, key, page AS page_no, CAST(1 AS BIGINT) AS evidence_count, 'b' || turn AS block_ids, turn * 10.0::DOUBLE AS x1, 200.0::DOUBLE AS height FROM e WHERE own""",
)
def block_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _prefix_events(spark, sf_dir).where("event_type = 'block.extracted'")
    kind = f"struct<revision:bigint,field_key:string,page_no:bigint,evidence_count:bigint,source_block_ids:array<string>,bbox:{assemble.BBOX},height:double>"
    p = F.col("p")
    return rows.select(F.col("task_id").cast("long").alias("conv_id"), F.from_json("payload", kind).alias("p")).select(
        "conv_id", p["revision"].alias("revision"), p["field_key"].alias("key"), p["page_no"].alias("page_no"), p["evidence_count"].alias("evidence_count"),
        F.array_join(p["source_block_ids"], ",").alias("block_ids"), p["bbox"]["x1"].cast("double").alias("x1"), p["height"].alias("height"),
    )


def _text_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "orders").select(
        F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("doc_id"), F.lit("text").alias("source_type"),
        F.when(F.col("o_orderkey") % 10 != 0, F.concat(F.lit("priority: "), F.col("o_orderpriority"), F.lit("\nstatus: "), F.col("o_orderstatus"))).alias("text"), none.alias("url"), none.alias("file_name"), none.alias("mime_type"),
    )


@query(
    "cache_replay",
    """WITH r AS (SELECT o_orderkey, o_orderpriority AS priority, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY o_orderkey) - 1 AS nth FROM orders WHERE o_orderkey % 10 <> 0)
SELECT o_orderkey, 'succeeded' AS status, nth > 0 AS cached, priority, CASE WHEN nth > 0 THEN 'cache hit (hit_count=' || nth || ', created_at_ms=5)' END AS message FROM r
UNION ALL SELECT o_orderkey, 'failed', false, NULL, 'content is required' FROM orders WHERE o_orderkey % 10 = 0""",
)
def cache_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = engine.run_batch(_text_requests(spark, sf_dir), SchemaSpec("q", "1", (FieldSpec("priority"),)), now_ms=5)
    return done.tasks.select(F.col("task_id").cast("long").alias("o_orderkey"), "status", "cached", plain_string(field(0)["value_json"]).alias("priority"), "message")


@query(
    "failure_events",
    """WITH f AS (SELECT conv_id, turn, CASE turn % 4 WHEN 2 THEN 'bytes are required' WHEN 3 THEN 'unknown kind' WHEN 0 THEN 'content is required' ELSE 'url is required' END AS message FROM conversations),
e AS (SELECT *, unnest(['task.accepted', 'stage.changed', 'failed']) AS event_type, unnest([1, 2, 3]) AS sequence FROM f)
SELECT conv_id, turn, CAST(sequence AS INTEGER) AS sequence, event_type, CASE WHEN sequence > 1 THEN message END AS message, CASE sequence WHEN 2 THEN 'failed' END AS status FROM e""",
)
def failure_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.get(F.array(*(F.lit(k) for k in ("html", "url", "pdf", "spreadsheet"))), (F.col("turn") % 4).cast("int"))
    failed = table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("doc_id"), ingest.input_error(kind, F.lit(" "), F.lit("")).alias("error"))
    part = F.split("task_id", ":")
    said = lambda name: F.get_json_object("payload", f"$.{name}").alias(name)
    return incremental.sequenced(incremental.failure_events(failed)).select(part[0].cast("long").alias("conv_id"), part[1].cast("long").alias("turn"), "sequence", "event_type", said("message"), said("status"))


# ---- OCR answers as documents ----


def _ocr_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Worker answers made of conversations: a page for each turn with a flat block list, sizes and a request id."""
    turn = F.struct("turn", "role", "text")
    page = lambda x: F.struct(
        (x["turn"] + 1).cast("int").alias("page_no"), (x["turn"] * 10 + 1).cast("float").alias("width"), F.lit(0.0).cast("float").alias("height"), F.lit(90.0).cast("float").alias("rotation_degrees"), (x["turn"] * 5).alias("timing_ms")
    )
    block = lambda x, i: F.struct(F.when(i % 2 == 0, F.concat(F.lit("id"), i.cast("string"))).alias("block_id"), (x["turn"] + 1).cast("int").alias("page_no"), F.concat(F.lit(" "), x["role"]).alias("text"), F.lit(0.25).alias("confidence"))
    rows = dealt(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), "conv_id").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    answer = F.to_json(F.struct(F.transform("t", page).alias("pages"), F.transform("t", block).alias("blocks"), F.lit(" req ").alias("request_id"), F.array(F.lit("w"), F.lit(" w ")).alias("warnings"), F.lit("mod").alias("model")))
    none = F.lit(None).cast("string")
    answers = rows.select(F.col("conv_id").cast("string").alias("doc_id"), none.alias("file_name"), none.alias("mime_type"), answer.alias("answer"))
    return ocr.documents(ocr.parse_answers(answers), "image", "own", "inproc")


@query(
    "ocr_document",
    """WITH t AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS page FROM conversations)
SELECT conv_id, page AS page_no, turn * 10 + 1.0::DOUBLE AS width, CASE WHEN (page - 1) % 2 = 0 THEN 'id' || (page - 1) ELSE 'ocr-p' || (turn + 1) || '-b' || page END AS block_id, role AS text, 0.25::DOUBLE AS confidence FROM t""",
)
def ocr_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ocr_documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("conv_id"), each("pages").alias("p"))
    b = F.col("p.blocks")[0]
    return rows.select("conv_id", F.col("p.page_no").cast("long").alias("page_no"), F.col("p.width").cast("double").alias("width"), b["block_id"].alias("block_id"), b["text"].alias("text"), b["confidence"].cast("double").alias("confidence"))


@query(
    "page_metadata",
    """WITH t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS page, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT conv_id, page AS page_no, '90' AS rotation, nullif(turn * 5, 0) AS timing, 'req' AS request, CAST(1 AS BIGINT) AS blocks, CAST(0 AS BIGINT) AS lines, 'w' AS warning, 'mod' AS model FROM t""",
)
def page_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ocr_documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("conv_id"), F.col("metadata.extra").alias("m"), each("pages").alias("p"))
    n, m = F.col("p.page_no"), F.col("m")
    one = lambda name: incremental.page_value(m, n, name)
    request = F.coalesce(one("request_id"), F.try_element_at(m, F.lit("ocr_request_id")))
    return rows.select(
        "conv_id", n.cast("long").alias("page_no"), one("rotation_degrees").alias("rotation"), one("timing_ms").cast("long").alias("timing"), request.alias("request"), one("block_count").cast("long").alias("blocks"),
        one("line_count").cast("long").alias("lines"), F.array_join(incremental.page_warnings(m, n), "|").alias("warning"), F.try_element_at(m, F.lit("ocr_model")).alias("model"),
    )


# ---- answers of models ----


def _dealt_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers dealt by the id of their document, so that joins by it find them in place."""
    return dealt(table(spark, sf_dir, "customer").withColumn("doc_id", F.col("c_custkey").cast("string")), "doc_id")


def _customer_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _dealt_customers(spark, sf_dir)
    return rendered(rows, F.col("doc_id"), line("Name", F.col("c_name")), line("Segment", F.col("c_mktsegment")), one_block=False)


@query(
    "schema_left_join",
    """SELECT c_custkey, '"' || c_mktsegment || '"' AS segment, CASE WHEN c_custkey % 2 = 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS confidence, CAST(1 AS BIGINT) AS n_evidence, CAST(c_nationkey AS VARCHAR) AS nation, 'null' AS absent FROM customer""",
)
def schema_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.col("c_custkey") % 2 == 0
    item = lambda key, value, more="": F.concat(F.lit(f'{{"key":"{key}","value":'), value, F.lit(more + "}"))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    listed = F.concat(F.lit('{"fields":['), item("segment", quoted(F.col("c_mktsegment")), ',"score":" 0.5 "'), F.lit(","), item("nation", F.col("c_nationkey").cast("string")), F.lit("]}"))
    root = F.concat(F.lit('{"segment":'), quoted(F.col("c_mktsegment")), F.lit(',"segment_confidence":7,"nation":'), F.col("c_nationkey").cast("string"), F.lit("}"))
    answers = _dealt_customers(spark, sf_dir).select("doc_id", F.when(even, listed).otherwise(root).alias("answer"))
    good, _ = models.join_answers(answers, _customer_documents(spark, sf_dir), SchemaSpec("q", "1", (FieldSpec("segment"), FieldSpec("nation", "number"), FieldSpec("absent"))))
    return good.select(
        F.col("doc_id").cast("long").alias("c_custkey"), field(0)["value_json"].alias("segment"), field(0)["confidence"].cast("double").alias("confidence"), F.size(field(0)["evidences"]).cast("long").alias("n_evidence"),
        field(1)["value_json"].alias("nation"), field(2)["value_json"].alias("absent"),
    )


@query(
    "evidence_by_text",
    """SELECT c_custkey, 'Segment: ' || c_mktsegment AS by_block, CASE WHEN c_custkey % 2 = 0 THEN c_name || chr(10) || 'segment' ELSE NULL END AS by_text FROM customer""",
)
def evidence_by_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("doc_id"), "c_name", "c_mktsegment")
    docs = _customer_documents(spark, sf_dir).join(rows, "doc_id")
    blocks = assemble.blocks_of(F.col("pages"))
    across = F.when(F.col("doc_id").cast("long") % 2 == 0, F.concat("c_name", F.lit("\nsegment"))).otherwise("nowhere")
    text = lambda needle: F.get(models.evidence_by_text(needle, F.col("plain_text"), blocks), 0)["text"]
    return docs.select(F.col("doc_id").cast("long").alias("c_custkey"), text(F.lower("c_mktsegment")).alias("by_block"), text(across).alias("by_text"))


@query("evidence_by_ids", "SELECT c_custkey, CAST(CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 1 END AS BIGINT) AS n, CASE WHEN c_custkey % 3 > 0 THEN 'Segment: ' || c_mktsegment END AS text FROM customer")
def evidence_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = assemble.blocks_of(F.col("pages"))
    ids = F.when(F.col("doc_id").cast("long") % 3 == 0, F.array(F.lit(" "), F.lit("x"))).otherwise(F.array(F.concat(F.lit(" "), F.get(blocks, 1)["block_id"])))
    found = models.evidence_by_ids(ids, blocks)
    return _customer_documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("c_custkey"), F.size(found).cast("long").alias("n"), F.get(found, 0)["text"].alias("text"))


@query(
    "span_fields",
    """SELECT c_custkey, '{"name":"' || c_name || '","parts":["' || c_mktsegment || '","' || substr(c_mktsegment, 2) || '"]}' AS value, round(CAST((CAST(0.75 AS REAL) + CAST(0.375 AS REAL)) / CAST(2 AS REAL) AS DOUBLE), 6) AS confidence FROM customer""",
)
def span_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of the name, twice with different confidence, and of the segment with and without its first letter."""
    rows = table(spark, sf_dir, "customer")
    name, end = F.length("c_name"), F.length("c_name") + F.length("c_mktsegment")
    span = lambda path, a, b, c: F.struct(F.lit(path).alias("path"), a.cast("int").alias("start_char"), b.cast("int").alias("end_char"), F.lit(c).alias("confidence"))
    spans = F.array(span("who::name", F.lit(6), name + 7, 0.75), span("who::name", F.lit(6), name + 7, 0.5), span("who::parts", name + 16, end + 16, 0.5), span("who::parts", name + 17, end + 16, 0.25), span("who::parts", F.lit(5), F.lit(6), 0.9))
    told = rows.select(F.col("c_custkey").cast("string").alias("doc_id"), F.explode(spans).alias("s")).select("doc_id", "s.*")
    schema = SchemaSpec("q", "1", (FieldSpec("who", "object", children=(FieldSpec("name"), FieldSpec("parts", multiple=True))),))
    out = models.span_fields(told, _customer_documents(spark, sf_dir), schema)
    return out.select(F.col("doc_id").cast("long").alias("c_custkey"), field(0)["value_json"].alias("value"), F.round(field(0)["confidence"].cast("double"), 6).alias("confidence"))


@query(
    "uie_windows",
    """WITH w AS (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n FROM documents),
p AS (SELECT * FROM (VALUES ('a', 93, 68), ('a::b', 85, 60)) x(path, room, step)),
s AS (SELECT doc_id, path, n, room, step, unnest(range(0, greatest(CAST(ceil((n - room) / CAST(step AS DOUBLE)) AS BIGINT), 0) + 1)) AS win FROM w, p)
SELECT doc_id, path, CAST(win AS INTEGER) AS win, win * step AS first, greatest(least(n - win * step, room), 0) AS n_tokens, room - greatest(least(n - win * step, room), 0) AS padding FROM s""",
)
def uie_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.filter(F.split("text", r"\s+", -1), lambda x: x != "")
    out = models.prompt_windows(table(spark, sf_dir, "documents").select("doc_id", words.alias("tokens")), {"a": 4, "a::b": 12}, 100)
    return out.select("doc_id", "path", F.col("window").alias("win"), F.col("first").cast("long").alias("first"), F.size("tokens").cast("long").alias("n_tokens"), F.col("padding").cast("long").alias("padding"))


# ---- tensors ----


@query(
    "recognition_join",
    """SELECT user_id, event_id, upper(event_type) AS text, least((event_id % 100) / 100.0::DOUBLE, 0.5) AS confidence FROM events WHERE event_type <> 'error' AND user_id NOT IN (SELECT user_id FROM events WHERE event_id % 997 = 0)""",
)
def recognition_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    keys = (F.col("user_id").alias("image_id"), F.col("event_id").alias("patch_index"))
    box = F.lit(None).cast(assemble.BBOX).alias("bbox")
    seen = rows.where("event_id % 997 <> 0").select(*keys, F.lit(0.5).alias("score"), box)
    told = rows.select(*keys, F.when(F.col("event_type") == "error", "  ").otherwise(F.concat(F.lit(" "), F.upper("event_type"))).alias("text"), (F.col("event_id") % 100 / 100.0).alias("confidence"))
    lines, _ = vision.recognized_lines(seen, told)
    return lines.select(F.col("image_id").alias("user_id"), F.col("patch_index").alias("event_id"), "text", "confidence")


@query(
    "rotation_update",
    """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 0 ELSE (event_id % 4) * 90 END AS rotation, CASE WHEN event_id % 7 = 0 THEN '0,1,2,3,4,5' ELSE ['0,1,2,3,4,5', '3,0,4,1,5,2', '5,4,3,2,1,0', '2,5,1,4,0,3'][1 + event_id % 4] END AS vals,
  CAST(CASE WHEN event_id % 7 <> 0 AND event_id % 2 = 1 THEN 2 ELSE 3 END AS INTEGER) AS width FROM events""",
)
def rotation_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.lit(0).alias("image_id"), F.col("event_id").alias("patch_index"))
    patches = rows.select("*", F.lit(3).alias("width"), F.lit(2).alias("height"), F.lit(1).alias("channels"), F.array(*(F.lit(float(i)) for i in range(6))).alias("values"))
    classes = rows.select("*", ((F.col("patch_index") % 4) * 90 - 360).cast("double").alias("rotation_degrees"), F.when(F.col("patch_index") % 7 == 0, 0.0).otherwise(0.9).alias("confidence"))
    out = vision.rotate_patches(patches, classes)
    return out.select(F.col("patch_index").alias("event_id"), F.col("rotation").cast("long").alias("rotation"), F.array_join(F.transform("values", lambda x: x.cast("int")), ",").alias("vals"), "width")


@query(
    "patch_geometry",
    """WITH b AS (SELECT p_partkey, p_size * 3.0::DOUBLE AS x1, p_size * 1.0::DOUBLE AS y1, p_size * 3.0::DOUBLE + p_retailprice / 10 AS x2, p_size * 1.0::DOUBLE + 21 AS y2 FROM part),
c AS (SELECT p_partkey, CAST(greatest(0, least(floor(x1 / 2), 99)) AS INTEGER) AS x1, CAST(greatest(0, least(floor(y1 / 2), 49)) AS INTEGER) AS y1, CAST(greatest(1, least(ceil(x2 / 2), 100)) AS INTEGER) AS x2, CAST(greatest(1, least(ceil(y2 / 2), 50)) AS INTEGER) AS y2 FROM b)
SELECT *, CAST(least(greatest(round(CAST(CAST(x2 - x1 AS REAL) / CAST(y2 - y1 AS REAL) * 48 AS REAL)), 1), 320) AS INTEGER) AS patch_width FROM c WHERE x2 > x1 AND y2 > y1""",
)
def patch_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("p_size") * F.lit(3.0), F.col("p_size") * F.lit(1.0)
    box = F.struct(x.alias("x1"), y.alias("y1"), (x + F.col("p_retailprice") / 10).alias("x2"), (y + 21).alias("y2"))
    found = table(spark, sf_dir, "part").select("p_partkey", box.alias("b")).select("p_partkey", vision.patch_bounds(F.col("b"), F.lit(100), F.lit(50), F.lit(2.0), F.lit(2.0)).alias("g"))
    return found.where("g is not null").select("p_partkey", "g.*")


# ---- batches of a span model, JSON laid over JSON ----


@query(
    "tensor_plan_join",
    """WITH c AS (SELECT c_custkey AS k, 1 + c_custkey % 3 AS b, CASE WHEN c_custkey % 11 = 0 THEN 1 ELSE 0 END AS more, c_custkey % 13 = 0 AS short, c_custkey % 4 AS form FROM customer),
e AS (SELECT *, CASE WHEN form = 3 AND b > 1 THEN 'unsupported UIE output tensor rank `4` with shape [' || b || ', 1, 1, 5]' WHEN form = 3 AND b = 1 AND short THEN 'UIE output tensor shape [5] expects 5 values, got 4'
  WHEN short THEN 'UIE output tensor shape [' || b || ', ' || ['5', '5, 1', '1, 5'][1 + form] || '] expects ' || b * 5 || ' values, got ' || b * 5 - 1
  WHEN more = 1 THEN 'UIE output batch size mismatch: start=' || b || ', end=' || b || ', plans=' || b + 1 END AS error FROM c),
p AS (SELECT k, unnest(range(b)) AS plan_no FROM e WHERE error IS NULL)
SELECT k AS c_custkey, CAST(plan_no AS INTEGER) AS plan_no, array_to_string(list_transform(range(5), lambda i: (k + 7 * plan_no + 3 * i) % 10), ',') AS starts,
  array_to_string(list_transform(range(5), lambda i: (k + 5 * plan_no + 2 * i) % 10), ',') AS ends, CAST(NULL AS VARCHAR) AS error FROM p
UNION ALL SELECT k, NULL, NULL, NULL, error FROM e WHERE error IS NOT NULL""",
)
def tensor_plan_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of one to three windows of five tokens for each customer, in every shape that there is; some of a wrong size."""
    k, b, size = F.col("c_custkey"), (F.col("c_custkey") % 3 + 1).cast("int"), F.lit(5)
    form, one = F.col("c_custkey") % 4, F.lit(1)
    shape = F.when(form == 0, F.array(b, size)).when(form == 1, F.array(b, size, one)).when(form == 2, F.array(b, one, size)).when(b == 1, F.array(size)).otherwise(F.array(b, one, one, size))
    cells = F.sequence(F.lit(0), b * 5 - 1 - F.when(k % 13 == 0, 1).otherwise(0))
    value = lambda of_row, of_token: F.transform(cells, lambda i: ((k + F.floor(i / 5) * of_row + i % 5 * of_token) % 10 / 10.0).cast("float"))
    rows = table(spark, sf_dir, "customer")
    outputs = rows.select(k.alias("doc_id"), value(7, 3).alias("start_values"), shape.alias("start_shape"), value(5, 2).alias("end_values"), shape.alias("end_shape"))
    plans = rows.select(k.alias("doc_id"), F.explode(F.sequence(F.lit(0), b - 1 + F.when(k % 11 == 0, 1).otherwise(0))).alias("plan_no"))
    good, bad = tensors.join_plans(outputs, plans)
    tenths = lambda c: F.array_join(F.transform(c, lambda x: F.round(x * 10).cast("int")), ",")
    none = F.lit(None).cast("string")
    return good.select(F.col("doc_id").alias("c_custkey"), "plan_no", tenths("start_probs").alias("starts"), tenths("end_probs").alias("ends"), none.alias("error")).unionByName(
        bad.select(F.col("doc_id").alias("c_custkey"), F.lit(None).cast("int").alias("plan_no"), none.alias("starts"), none.alias("ends"), "error")
    )


@query(
    "json_deep_merge",
    """SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN '{"name":"' || c_name || '","place":{"nation":' || c_nationkey || ',"seg":null},"tags":["' || c_mktsegment || '"]}'
  WHEN c_custkey % 3 = 1 THEN '{"more":{"x":{"y":1,"z":2}},"name":"base","place":{"nation":' || c_nationkey || ',"seg":"' || c_mktsegment || '"},"tags":["' || c_mktsegment || '"]}'
  ELSE '{"name":"base","place":"' || c_mktsegment || '","tags":[1,2]}' END AS merged, CASE WHEN c_custkey % 5 = 0 THEN 'malformed JSON' END AS error FROM customer""",
)
def json_deep_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three texts of each customer, laid over one another; every fifth isn't JSON."""
    third, quoted = F.col("c_custkey") % 3, lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    base = F.concat(F.lit('{"tags": [1, 2], "name": "base", "place": {"nation": 0, "seg": '), quoted(F.col("c_mktsegment")), F.lit("}}"))
    listed = F.concat(F.lit(', "tags": ['), quoted(F.col("c_mktsegment")), F.lit("]}"))
    nation = F.concat(F.lit('{"place": {"nation": '), F.col("c_nationkey").cast("string"))
    second = F.when(third == 0, F.concat(nation, F.lit("}"), listed)).when(third == 1, F.concat(nation, F.lit('}, "more": {"x": {"y": 1}}'), listed)).otherwise(F.concat(F.lit('{"place": '), quoted(F.col("c_mktsegment")), F.lit("}")))
    last = F.when(third == 0, F.concat(F.lit('{"name": '), quoted(F.col("c_name")), F.lit(', "place": {"seg": null}}'))).when(third == 1, '{"more": {"x": {"z": 2}}}')
    texts = F.array(*(F.struct(F.lit(k).alias("rank"), x.alias("json")) for k, x in enumerate((base, F.when(F.col("c_custkey") % 5 == 0, "{").otherwise(second), last))))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.explode(texts).alias("t")).select("id", "t.*")
    good, bad = contracts.deep_merge(rows)
    return good.select(F.col("id").alias("c_custkey"), F.col("json").alias("merged"), F.lit(None).cast("string").alias("error")).unionByName(
        bad.select(F.col("id").alias("c_custkey"), F.lit(None).cast("string").alias("merged"), "error")
    )


@query(
    "page_tensor",
    """WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 8 ELSE 4 END AS w, 4 AS h, p_size % 3 + 1 AS a, p_size % 5 AS b FROM part WHERE p_partkey % 7 <> 0),
i AS (SELECT *, CASE WHEN w = 8 THEN 4 ELSE w END AS nw, CASE WHEN w = 8 THEN 2 ELSE h END AS nh FROM p),
t AS (SELECT i.*, o.x AS ox, o.y AS oy, s.x AS sx, s.y AS sy, w * 1.0::DOUBLE / nw AS r FROM i, (SELECT unnest(range(4)) AS x, y FROM (SELECT unnest(range(4)) AS y)) o, (SELECT unnest(range(8)) AS x, y FROM (SELECT unnest(range(4)) AS y)) s
  WHERE o.x < nw AND o.y < nh AND s.x < w AND s.y < h),
g AS (SELECT *, greatest(0, 1 - abs((sx - ((ox + 0.5) * r - 0.5)) / r)) * greatest(0, 1 - abs((sy - ((oy + 0.5) * r - 0.5)) / r)) AS weight FROM t),
v AS (SELECT p_partkey, w, h, nw, nh, ox, oy, unnest([0, 1, 2]) AS channel, unnest([sum(weight * (10 * a * sx + b * sy)) / sum(weight), sum(weight * (200 - 20 * sx)) / sum(weight), sum(weight * (7 * sy + 3)) / sum(weight)]) AS x FROM g GROUP BY 1, 2, 3, 4, 5, 6, 7)
SELECT p_partkey, channel, w AS width, nw AS resized_width, nh AS resized_height, array_to_string(list(CAST(floor(x + 0.5) AS INTEGER) ORDER BY oy, ox), ',') AS vals, CAST(NULL AS VARCHAR) AS error FROM v GROUP BY 1, 2, 3, 4, 5
UNION ALL SELECT p_partkey, NULL, NULL, NULL, NULL, NULL, 'image: unsupported kind of image' FROM part WHERE p_partkey % 7 = 0""",
)
def page_tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gradients of two sizes as bitmaps made of the table's columns, the larger ones halved; every seventh is no image."""
    rows = dealt(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_name"), "p_partkey")
    width, a, b = F.when(F.col("p_partkey") % 2 == 0, 8).otherwise(4), F.col("p_size") % 3 + 1, F.col("p_size") % 5
    byte = lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")
    pixel = lambda x, y: F.concat(byte(7 * y + 3), byte(200 - 20 * x), byte(10 * a * x + b * y))
    pixels = F.flatten(F.transform(F.sequence(F.lit(3), F.lit(0)), lambda y: F.transform(F.sequence(F.lit(0), width - 1), lambda x: pixel(x, y))))
    head = F.concat(F.lit("424D00000000000000003600000028000000"), byte(width), F.lit("000000" + "04000000" + "01001800" + "00" * 24))
    content = F.when(F.col("p_partkey") % 7 == 0, F.encode(F.col("p_name"), "UTF-8")).otherwise(F.unhex(F.concat(head, F.array_join(pixels, ""))))
    out = images.page_tensors(rows.select(F.col("p_partkey").cast("string").alias("doc_id"), content.alias("content")), max_side=4)
    return out.select(
        F.col("doc_id").cast("long").alias("p_partkey"), "channel", "width", "resized_width", "resized_height", F.array_join(F.transform("values", lambda v: F.round(v * 255).cast("int")), ",").alias("vals"), "error"
    )


# ---- uploads with a schema each ----

#: Twenty schemas of customers: each asks for the name or the segment under another label, as a string or a list, alone or inside an object.
_SHAPES = ("plain", "multiple", "object", "array")


def _upload_schema(k: int) -> str:
    inner = FieldSpec("name" if k % 2 == 0 else "segment", required=k % 3 == 0, multiple=_SHAPES[k % 4] in ("multiple", "array"), hints=(f"label{k}",))
    fields = {"object": FieldSpec("who", "object", children=(inner, FieldSpec("balance", "number"))), "array": FieldSpec("who", "array", children=(inner,))}
    return SchemaSpec(f"s{k}", "1", (fields.get(_SHAPES[k % 4], inner),)).to_json()


def _customer_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text of each customer as a file; the label of the name depends on the schema that asks for it, every 50th file isn't UTF-8."""
    rows = table(spark, sf_dir, "customer")
    k = (F.col("c_custkey") % 20).cast("string")
    text = F.concat_ws("\n", F.concat(F.lit("label"), k, F.lit(": "), F.col("c_name")), line("segment", F.col("c_mktsegment")), line("balance", F.col("c_nationkey")))
    content = F.when(F.col("c_custkey") % 50 == 0, F.unhex(F.lit("FFFE00"))).otherwise(F.encode(text, "UTF-8"))
    return rows.select(F.concat(F.lit("c/"), F.col("c_custkey").cast("string"), F.lit(".txt")).alias("path"), content.alias("content"), F.octet_length(content).cast("long").alias("byte_size"))


def _uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for each customer's file with one of the schemas; some have none, ask for a file that isn't there or in a way that there isn't."""
    key, none = F.col("c_custkey"), F.lit(None).cast("string")
    schemas = F.array(*(F.lit(_upload_schema(k)) for k in range(20)))
    return table(spark, sf_dir, "customer").select(
        F.lpad(key.cast("string"), 12, "0").alias("task_id"), F.concat(F.lit("c/"), F.when(key % 70 == 1, "none").otherwise(key.cast("string")), F.lit(".txt")).alias("path"), none.alias("file_name"),
        none.alias("mime_type"), F.when(key % 30 == 7, "later").when(key % 2 == 0, " async ").alias("mode"), F.when(key % 40 != 9, F.get(schemas, (key % 20).cast("int"))).alias("schema"),
        F.when(key % 3 == 0, '{"return_evidence":true}').alias("options"),
    )


_UPLOAD_SQL = """WITH c AS (SELECT *, c_custkey % 20 AS k, CASE WHEN c_custkey % 40 = 9 THEN 'multipart field `schema` is required' WHEN c_custkey % 30 = 7 THEN 'mode must be sync or async'
  WHEN c_custkey % 70 = 1 THEN 'file not found' WHEN c_custkey % 50 = 0 THEN 'not UTF-8' END AS message FROM customer),
v AS (SELECT *, CASE WHEN k % 2 = 0 THEN c_name ELSE c_mktsegment END AS word, k % 4 AS shape FROM c),
w AS (SELECT *, CASE WHEN k % 2 = 0 THEN [c_name] ELSE [c_mktsegment, c_name] END AS words FROM v)"""


@query(
    "upload_requests",
    _UPLOAD_SQL
    + """ SELECT c_custkey, CASE WHEN message IS NULL THEN 'succeeded' ELSE 'failed' END AS status, message,
  CASE WHEN message IS NOT NULL THEN NULL WHEN shape = 0 THEN '"' || word || '"' WHEN shape = 1 THEN '["' || array_to_string(words, '","') || '"]'
    WHEN shape = 2 THEN '{"name":"' || word || '","balance":' || c_nationkey || '}' ELSE '[' || array_to_string(list_transform(words, lambda x: '{"segment":"' || x || '"}'), ',') || ']' END AS value,
  CASE WHEN message IS NOT NULL THEN NULL WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END::BIGINT AS n_evidence FROM w""",
)
def upload_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = engine.run_uploads(_customer_files(spark, sf_dir), _uploads(spark, sf_dir))
    evidences = F.when(F.col("fields").isNotNull(), F.size(field(0)["evidences"]).cast("long"))
    return done.tasks.select(F.col("task_id").cast("long").alias("c_custkey"), "status", "message", field(0)["value_json"].alias("value"), evidences.alias("n_evidence"))


@query(
    "upload_failures",
    _UPLOAD_SQL
    + """, e AS (SELECT *, c_custkey % 2 = 0 AND c_custkey % 30 <> 7 AS later, message = 'not UTF-8' AS begun FROM w WHERE message IS NOT NULL),
x AS (SELECT c_custkey, message, unnest(list_filter([{'o': 1, 'e': 'task.accepted', 's': NULL}, CASE WHEN later THEN {'o': 2, 'e': 'stage.changed', 's': 'queued'} END, CASE WHEN begun THEN {'o': 3, 'e': 'stage.changed', 's': 'parsing'} END,
  CASE WHEN NOT later THEN {'o': 4, 'e': 'stage.changed', 's': 'failed'} END, {'o': 5, 'e': 'failed', 's': NULL}], lambda y: y IS NOT NULL)) AS x FROM e)
SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY x.o) AS INTEGER) AS sequence, x.e AS event_type, x.s AS stage,
  CASE WHEN x.o > 3 THEN message WHEN x.s = 'queued' THEN 'task has been accepted for background processing' END AS message FROM x""",
)
def upload_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = engine.run_uploads(_customer_files(spark, sf_dir), _uploads(spark, sf_dir))
    failed = done.tasks.where("status = 'failed'").select("task_id")
    return done.events.join(failed, "task_id", "left_semi").select(
        F.col("task_id").cast("long").alias("c_custkey"), "sequence", "event_type", "stage", F.get_json_object("payload", "$.message").alias("message")
    )


@query(
    "inline_requests",
    """WITH o AS (SELECT o_orderkey, o_orderpriority AS p, o_orderstatus AS s, o_orderkey % 3 AS k, (o_orderkey % 25 = 0) AS blank FROM orders),
n AS (SELECT *, row_number() OVER (PARTITION BY p, s, k, blank ORDER BY o_orderkey) - 1 AS nth FROM o)
SELECT o_orderkey, CASE WHEN blank THEN 'failed' ELSE 'succeeded' END AS status, NOT blank AND nth > 0 AS cached,
  CASE WHEN blank THEN NULL WHEN k = 0 THEN '"' || p || '"' WHEN k = 1 THEN '["' || s || '"]' ELSE '{"priority":"' || p || '","status":"' || s || '"}' END AS value FROM n""",
)
def inline_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests as JSON lines, each with one of three schemas as an object of its own; every 25th has no content."""
    where = fresh_dir(spark, "requests")
    both = (FieldSpec("priority"), FieldSpec("status"))
    kinds = ((both[0],), (FieldSpec("status", multiple=True),), (FieldSpec("order", "object", children=both),))
    schemas = F.array(*(F.lit(SchemaSpec("s", "1", fields).to_json()) for fields in kinds))
    key = F.col("o_orderkey")
    text = F.when(key % 25 != 0, F.concat(line("priority", F.col("o_orderpriority")), F.lit("\n"), line("status", F.col("o_orderstatus"))))
    head = F.to_json(F.struct(F.lpad(key.cast("string"), 12, "0").alias("task_id"), F.lit("text").alias("kind"), text.alias("content")))
    told = F.concat(F.expr("left(j, length(j) - 1)"), F.lit(', "schema": '), F.get(schemas, (key % 3).cast("int")), F.lit("}"))
    table(spark, sf_dir, "orders").withColumn("j", head).select(told.alias("value")).write.text(where)
    # inputs that are refused are told of as tasks too, so all that is JSON is run
    asked = spark.read.schema(ingest.FULL_REQUEST).json(where)
    done = engine.run_requests(asked)
    return done.tasks.select(F.col("task_id").cast("long").alias("o_orderkey"), "status", "cached", field(0)["value_json"].alias("value"))


# ---- model tensors and streams ----


@query(
    "heatmap_components",
    """WITH RECURSIVE c AS (SELECT user_id AS id, CAST((row_number() OVER (PARTITION BY user_id ORDER BY ts, value) - 1) AS BIGINT) AS i, CAST(value AS REAL) AS v FROM events),
p AS (SELECT id, i, v FROM c WHERE v >= 50), e AS (SELECT a.id, a.i AS i, b.i AS j FROM p a JOIN p b ON a.id = b.id AND (abs(a.i - b.i) = 8 OR (abs(a.i - b.i) = 1 AND a.i // 8 = b.i // 8))),
r AS (SELECT id, i, i AS j FROM p UNION SELECT r.id, r.i, e.j FROM r JOIN e ON e.id = r.id AND e.i = r.j),
k AS (SELECT id, i, max(j) AS label FROM r GROUP BY 1, 2),
g AS (SELECT k.id, label, min(i % 8) AS x1, min(i // 8) AS y1, max(i % 8) + 1 AS x2, max(i // 8) + 1 AS y2, avg(CAST(v AS DOUBLE)) AS confidence, count(*) AS n FROM k JOIN p USING (id, i) GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY y1, x1, label) - 1 AS INTEGER) AS position, CAST(x1 * 4 AS REAL) AS x1, CAST(y1 * 4 AS REAL) AS y1, CAST(x2 * 4 AS REAL) AS x2, CAST(y2 * 4 AS REAL) AS y2,
  CAST(confidence AS REAL) AS confidence, CAST(n AS INTEGER) AS pixels FROM g""",
)
def heatmap_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map of eight columns from all events of each user, the last row padded with zeros."""
    every = F.transform(F.sort_array(F.collect_list(F.struct("ts", "value"))), lambda x: x["value"].cast("float"))
    maps = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(every.alias("values")).withColumns({"height": F.ceil(F.size("values") / 8).cast("int"), "width": F.lit(8)})
    padded = F.concat("values", F.array_repeat(F.lit(0.0).cast("float"), F.col("height") * 8 - F.size("values")))
    return vision.detect(maps.withColumn("values", padded), least=50.0, pixels=2, scale=4.0)


@query("stream_tasks", "SELECT 't' || s_suppkey AS task_id, CASE WHEN s_suppkey % 10 = 0 THEN 'failed' ELSE 'succeeded' END AS status, CASE WHEN s_suppkey % 10 = 0 THEN 'content is required' END AS message FROM supplier")
def stream_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docweft.streaming import tasks

    where = fresh_dir(spark, "stream")
    rows = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("t"), F.col("s_suppkey").cast("string")).alias("task_id"), F.lit("async").alias("mode"), F.lit("text").alias("kind"),
        F.when(F.col("s_suppkey") % 10 != 0, F.concat(F.lit("name: "), F.col("s_name"))).alias("content"),
    )
    rows.repartition(2, "task_id").write.mode("overwrite").json(f"{where}/inbox")
    tasks.run_tasks(spark, f"{where}/inbox", where, SchemaSpec("s", "1", (FieldSpec("name"),))).awaitTermination()
    return tasks.tasks(spark, where).select("task_id", "status", "message")


@query(
    "stream_cache",
    """WITH r AS (SELECT o_orderkey, o_orderpriority AS p, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 2 END AS file FROM orders),
n AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY file, lpad(o_orderkey::VARCHAR, 12, '0')) - 1 AS nth FROM r)
SELECT o_orderkey, nth > 0 AS cached, CASE WHEN nth > 0 THEN nth END AS hit_count, '"' || p || '"' AS value FROM n""",
)
def stream_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests in two files, even and odd orders, a batch each: what the first asked for, the second finds in the cache."""
    from docweft.streaming import tasks

    where = fresh_dir(spark, "stream")
    rows = table(spark, sf_dir, "orders").select(
        F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("task_id"), F.lit("async").alias("mode"), F.lit("text").alias("kind"), F.concat(F.lit("priority: "), F.col("o_orderpriority")).alias("content"),
    )
    schema = SchemaSpec("s", "1", (FieldSpec("priority"),))
    for odd in (0, 1):
        rows.where(F.col("task_id").cast("long") % 2 == odd).write.mode("append").json(f"{where}/inbox")
        tasks.run_tasks(spark, f"{where}/inbox", where, schema).awaitTermination()
    log = tasks.events(spark, where).where("event_type = 'cache.hit'").select("task_id", F.get_json_object("payload", "$.hit_count").cast("long").alias("hit_count"))
    out = tasks.tasks(spark, where).join(log, "task_id", "left")
    return out.select(F.col("task_id").cast("long").alias("o_orderkey"), "cached", "hit_count", F.get_json_object("fields", "$[0].value_json").alias("value"))
