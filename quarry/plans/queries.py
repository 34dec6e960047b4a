"""The engine's own queries over the given tables, each with SQL of the same meaning."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import fitted
from quarry.functions.conditions import condition
from quarry.functions.embed import Embedder, embed, hashing_embedder
from quarry.functions.languages import EXCLUDED_NAMES, language
from quarry.functions.scratch import scratch_dir
from quarry.operators import chunking, filters, index, knn_join, quantized, search, stats, vectors
from quarry.sources import tree
from quarry.sources.tables import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

MAX_FILE_BYTES = 20_000
EXCLUDED = (*EXCLUDED_NAMES, "src3", "de")
IGNORE_LINES = ("# comment", "*.bin", "src1/", "!src1/fr/*.md", "src2/en/**", "!src2/en/*.py", "doc1?.*", "/src4/es/")
EXCLUDE_GLOBS = ("*.sql", "src5/*", "doc[12]*.js")
INCLUDE_GLOBS = ("*.py", "en/*.md", "src7/*/doc*.ts")
RULES = {
    x: (
        chunking.UnitRule("heading", r"^[A-Z][a-z]*\.$", prefix=True),
        chunking.UnitRule("shout", r"^[A-Z]+!!"),
        chunking.UnitRule("table", r"^[^|]* \| "),
        chunking.UnitRule("prose", r"^[A-Z]", r"^([A-Za-z]+)"),
    )
    for x in ("en", "fr", "de", "es")
}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- SQL that several queries share

FILES = """files AS (
  SELECT doc_id, source || '/' || lang || '/doc' || doc_id || (['.py', '.js', '.ts', '.md', '.txt', '.sql', '.PY', '.bin'])[doc_id % 8 + 1] AS path,
         strlen(text) AS size, text, source, lang FROM documents),
named AS (
  SELECT *, string_split(path, '/') AS parts, lower(regexp_extract(path, '(\\.[^./]+)$', 1)) AS suffix,
         CASE lower(regexp_extract(path, '(\\.[^./]+)$', 1)) WHEN '.py' THEN 'python' WHEN '.js' THEN 'javascript' WHEN '.ts' THEN 'typescript'
              WHEN '.md' THEN 'markdown' WHEN '.sql' THEN 'sql' END AS language FROM files)"""

RANGES = """p AS (SELECT {key}, list_transform(string_split({text}, chr(10)), lambda x: length(x)) AS ln FROM {table}),
c AS (
  SELECT {key}, ln, 0 AS cno, 0 AS pe, 1 AS s,
         coalesce((SELECT min(j) FROM range(1, len(ln) + 1) t(j) WHERE list_sum(ln[1:j]) + j >= 1000), len(ln)) AS e FROM p
  UNION ALL
  SELECT {key}, ln, cno + 1, e, ns,
         coalesce((SELECT min(j) FROM range(ns, len(ln) + 1) t(j) WHERE j > e AND list_sum(ln[ns:j]) + (j - ns + 1) >= 1000), len(ln))
  FROM (SELECT *, list_sum(ln[s:e]) + (e - s + 1) >= 1000 AS filled,
               coalesce((SELECT max(k) + 1 FROM range(s, e + 1) t(k) WHERE list_sum(ln[k:e]) + (e - k) > 100), s) AS ns FROM c) z
  WHERE e < len(ln) OR (filled AND ns <= e AND pe < e))"""

INDEX = f"""WITH RECURSIVE {FILES},
{RANGES.format(key="doc_id", text="text", table="documents")},
idx AS (
  SELECT n.source AS index_name, n.path, c.cno AS chunk_no, c.s AS start_line, c.e AS end_line, coalesce(n.language, 'unknown') AS language,
         array_to_string(string_split(n.text, chr(10))[c.s:c.e], chr(10)) AS content, c.doc_id
  FROM c JOIN named n USING (doc_id))"""

UNITS = """lines AS (
  SELECT doc_id, lang AS language, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n
  FROM documents WHERE lang IN ('en', 'fr', 'de', 'es')),
kinds AS (
  SELECT *, CASE WHEN regexp_matches(line, '^(?:\\s|$|[\\])}])') THEN 'cont' WHEN regexp_matches(line, '^[A-Z][a-z]*\\.$') THEN 'heading'
                 WHEN regexp_matches(line, '^[A-Z]+!!') THEN 'shout' WHEN regexp_matches(line, '^[^|]* \\| ') THEN 'table'
                 WHEN regexp_matches(line, '^[A-Z]') THEN 'prose' ELSE 'other' END AS kind FROM lines),
starts AS (
  SELECT *, CASE WHEN kind = 'cont' OR coalesce(lag(kind) OVER (PARTITION BY doc_id ORDER BY n) = 'heading', false) THEN 0 ELSE 1 END AS st FROM kinds),
numbered AS (SELECT *, sum(st) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS unit FROM starts),
grouped AS (
  SELECT doc_id, language, unit, arg_min(kind, n) AS kind, arg_min(line, n) AS head, min(n) AS f, max(CASE WHEN trim(line) <> '' THEN n END) AS l,
         list(line ORDER BY n) AS ls FROM numbered GROUP BY ALL),
units AS (
  SELECT doc_id, language, kind, CASE WHEN kind = 'prose' THEN regexp_extract(head, '^([A-Za-z]+)', 1) END AS name, f + 1 AS start_line, l + 1 AS end_line,
         array_to_string(ls[1:l - f + 1], chr(10)) AS content FROM grouped WHERE kind NOT IN ('other', 'cont'))"""

UNIT_CHUNKS = f"""WITH RECURSIVE {UNITS},
big AS (SELECT row_number() OVER () AS uid, * FROM units WHERE length(content) > 1000),
{RANGES.format(key="uid", text="content", table="big")},
unit_chunks AS (
  SELECT doc_id, language, kind, name, 0 AS chunk_no, start_line, end_line, content FROM units WHERE length(content) <= 1000
  UNION ALL
  SELECT doc_id, language, kind, name, cno, start_line + s - 1, start_line + e - 1, array_to_string(string_split(content, chr(10))[s:e], chr(10)) FROM c JOIN big USING (uid))"""


def hashed(name: str, key: str, text: str, table: str) -> str:
    """SQL of the hashing embedder: name(key, b, v), the non-zero numbers of each vector."""
    return f"""{name}_t AS (SELECT {key}, md5(unnest(regexp_extract_all(lower({text}), '[a-z0-9]+'))) AS m FROM {table}),
{name}_b AS (SELECT {key}, ('0x' || substr(m, 1, 8))::BIGINT % 64 AS b, sum(1 - 2 * ((strpos('0123456789abcdef', substr(m, 9, 1)) - 1) % 2))::DOUBLE AS w FROM {name}_t GROUP BY ALL),
{name} AS (SELECT {key}, b, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS v FROM {name}_b WHERE w <> 0)"""


# ---- sources and filters


def _rows(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "path", "size")


@query(f"WITH {FILES} SELECT doc_id, path, size, suffix FROM named")
def scan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("doc_id", "path", "size", "suffix")


@query(f"WITH {FILES} SELECT path, size, suffix, md5(text) AS content_md5 FROM named WHERE suffix IN ('.py', '.md') AND size <= {MAX_FILE_BYTES} AND text IS NOT NULL AND NOT list_has_any(parts, ['src3'])")
def scan_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a real tree in the shared folder, which must be one of a file system, read through the source."""
    root = scratch_dir(spark, f"tree-{uuid.uuid4().hex}")
    if "://" in root.removeprefix("file://"):
        raise ValueError("a source tree is read through the operating system: spark.checkpoint.dir is no folder of it")
    top = root.removeprefix("file://").removeprefix("file:")

    def put(batches):
        for b in batches:
            for path, text in zip(b.column(0), b.column(1)):  # one text at a time, not all of a batch
                at = os.path.join(top, path.as_py())
                os.makedirs(os.path.dirname(at), exist_ok=True)
                with open(f"{at}.part{os.getpid()}", "wb") as f:
                    f.write(text.as_buffer())
                os.replace(f.name, at)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    files(spark, sf_dir).where("text IS NOT NULL").select("path", "text").mapInArrow(put, "n bigint").agg(F.sum("n")).collect()
    read = tree.read_tree(spark, top, skip_names=("src3",), where=F.col("suffix").isin(".py", ".md") & (F.col("size") <= MAX_FILE_BYTES))
    return read.select(F.col("rel_path").alias("path"), "size", "suffix", F.md5("content").alias("content_md5"))


@query(f"WITH {FILES} SELECT doc_id, path, size FROM named WHERE NOT list_has_any(parts, ['src3', 'de', 'node_modules', '.git', 'dist', 'build', '.env'])")
def filter_default_excludes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(filters.default_excludes(files(spark, sf_dir), EXCLUDED))


@query(f"""WITH {FILES} SELECT doc_id, path, size FROM named
WHERE NOT (suffix = '.bin' OR regexp_matches(parts[3], '^doc1[^/]\\..*$') OR parts[1] = 'src1' OR (parts[1] = 'src2' AND parts[2] = 'en' AND NOT ends_with(path, '.py'))
           OR (parts[1] = 'src4' AND parts[2] = 'es')) OR (parts[1] = 'src2' AND parts[2] = 'en' AND ends_with(path, '.py') AND NOT regexp_matches(parts[3], '^doc1[^/]\\..*$'))""")
def filter_ignore_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(filters.ignore_rules(files(spark, sf_dir), IGNORE_LINES))


@query(f"WITH {FILES} SELECT doc_id, path, size FROM named WHERE NOT (ends_with(path, '.sql') OR parts[1] = 'src5' OR regexp_matches(parts[3], '^doc[12].*\\.js$'))")
def filter_exclude_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(filters.exclude_globs(files(spark, sf_dir), EXCLUDE_GLOBS))


@query(f"WITH {FILES} SELECT doc_id, path, size FROM named WHERE ends_with(path, '.py') OR (parts[2] = 'en' AND ends_with(path, '.md')) OR (parts[1] = 'src7' AND regexp_matches(parts[3], '^doc.*\\.ts$'))")
def filter_include_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(filters.include_globs(files(spark, sf_dir), INCLUDE_GLOBS))


@query(f"WITH {FILES} SELECT doc_id, path, size FROM named WHERE suffix <> '.bin'")
def filter_binary_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(filters.binary_suffixes(files(spark, sf_dir)))


@query("SELECT doc_id FROM documents WHERE strpos(text, ' | ') = 0 AND length(text) % 5 <> 0")
def filter_nul_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables get a NUL after ten characters, and every text of a length divisible by 5 counts as unreadable."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    content = F.when(F.length("text") % 5 != 0, F.when(F.contains("text", F.lit(" | ")), F.concat(F.left("text", F.lit(10)), F.lit("\0"), F.col("text"))).otherwise(F.col("text")))
    return filters.nul_probe(docs.withColumn("content", content.cast("binary"))).select("doc_id")


@query(f"WITH {FILES} SELECT doc_id, path, size FROM named WHERE size <= {MAX_FILE_BYTES}")
def drop_oversized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(filters.drop_oversized(files(spark, sf_dir), MAX_FILE_BYTES))


@query(f"WITH {FILES} SELECT doc_id, path, language FROM named")
def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("doc_id", "path", language(F.col("name")).alias("language"))


@query("SELECT doc_id, md5(text || chr(10) || 'end') AS text_md5 FROM documents")
def decode_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.concat(F.col("text").cast("binary"), F.unhex(F.lit("FFFE0D0A")), F.lit("end").cast("binary")).alias("content"))
    return chunking.decode_text(docs, ["doc_id"]).select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


# ---- statistics


def _kept_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.binary_suffixes(files(spark, sf_dir))


@query(f"""WITH {FILES} SELECT count(*) AS total_files, sum(size)::BIGINT AS total_bytes, round(sum(size) / 1048576.0, 6) AS total_mb,
  round(CASE WHEN sum(size) < 1024 THEN sum(size)::DOUBLE WHEN sum(size) < 1048576 THEN sum(size) / 1024.0 WHEN sum(size) < 1073741824 THEN sum(size) / 1048576.0 ELSE sum(size) / 1073741824.0 END, 2) AS amount,
  CASE WHEN sum(size) < 1024 THEN 'B' WHEN sum(size) < 1048576 THEN 'KB' WHEN sum(size) < 1073741824 THEN 'MB' ELSE 'GB' END AS unit,
  count(*) FILTER (size > {MAX_FILE_BYTES}) AS oversized_files FROM named WHERE suffix <> '.bin'""")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.corpus_stats(_kept_files(spark, sf_dir), MAX_FILE_BYTES)


@query(f"WITH {FILES} SELECT path, size FROM named WHERE size > {MAX_FILE_BYTES} AND suffix <> '.bin'")
def oversized_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.oversized(_kept_files(spark, sf_dir), MAX_FILE_BYTES)


@query(f"""WITH {FILES}, o AS (SELECT row_number() OVER (ORDER BY size DESC, path) AS rank, path, size FROM named WHERE size > {MAX_FILE_BYTES} AND suffix <> '.bin')
SELECT rank, path, size FROM o WHERE rank <= 5 UNION ALL SELECT 6, '... and ' || (count(*) - 5) || ' more', NULL FROM o HAVING count(*) > 5""")
def oversized_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.oversized_report(_kept_files(spark, sf_dir), MAX_FILE_BYTES)


@query(f"WITH {FILES} SELECT path, size FROM named WHERE suffix <> '.bin' ORDER BY size DESC, path LIMIT 5")
def largest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.largest(_kept_files(spark, sf_dir))


@query(f"""WITH {FILES}, t AS (SELECT count(*) AS f, round(sum(size) / 1048576.0, 6) AS mb, count(*) FILTER (size > {MAX_FILE_BYTES}) AS o FROM named WHERE suffix <> '.bin')
SELECT 'files' AS check_name, f::DOUBLE AS actual, 1000.0::DOUBLE AS limit_value, CASE WHEN f > 1000 THEN 'error' WHEN f > 800 THEN 'warning' ELSE 'ok' END AS severity FROM t
UNION ALL SELECT 'total_mb', mb, 500.0::DOUBLE, CASE WHEN mb > 500 THEN 'error' WHEN mb > 400 THEN 'warning' ELSE 'ok' END FROM t
UNION ALL SELECT 'oversized', o::DOUBLE, 0.0::DOUBLE, CASE WHEN o > 0 THEN 'warning' ELSE 'ok' END FROM t""")
def limit_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.limit_check(stats.corpus_stats(_kept_files(spark, sf_dir), MAX_FILE_BYTES), 1000, 500)


@query(f"WITH {FILES} SELECT count(*) AS n_files FROM named WHERE suffix <> '.bin'")
def count_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept_files(spark, sf_dir).agg(F.count("*").alias("n_files"))


# ---- chunks


@query(f"WITH RECURSIVE {RANGES.format(key='doc_id', text='text', table='documents')}, d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) SELECT doc_id, cno AS chunk_no, s AS start_line, e AS end_line, md5(array_to_string(l[s:e], chr(10))) AS content_md5 FROM c JOIN d USING (doc_id)")
def chunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunking.chunk_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
    return chunks.select("doc_id", "chunk_no", "start_line", "end_line", F.md5(F.col("content").cast("binary")).alias("content_md5"))


def _prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("lang").alias("language"), "text")


@query(f"WITH {UNITS} SELECT doc_id, language, kind, name, start_line, end_line, md5(content) AS content_md5 FROM units")
def chunk_structural(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = chunking.structural_units(_prose(spark, sf_dir), RULES)
    return units.select("doc_id", "language", "kind", "name", "start_line", "end_line", F.md5(F.col("content").cast("binary")).alias("content_md5"))


_CHUNK_COLUMNS = ("doc_id", "language", "kind", "name", "chunk_no", "start_line", "end_line")


@query(f"{UNIT_CHUNKS} SELECT doc_id, language, kind, name, chunk_no, start_line, end_line, md5(content) AS content_md5 FROM unit_chunks")
def split_large_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunking.chunk_units(chunking.structural_units(_prose(spark, sf_dir), RULES))
    return chunks.select(*_CHUNK_COLUMNS, F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query(f"""{UNIT_CHUNKS},
plain AS (SELECT doc_id, lang, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM units)),
{RANGES.format(key="doc_id", text="text", table="plain").replace("p AS", "p2 AS").replace("c AS (", "c2 AS (").replace("FROM p", "FROM p2").replace("FROM c)", "FROM c2)").replace("p2lain", "plain")}
SELECT doc_id, language, kind, name, chunk_no, start_line, end_line, md5(content) AS content_md5 FROM unit_chunks
UNION ALL
SELECT doc_id, lang, 'text', NULL, cno, s, e, md5(array_to_string(string_split(text, chr(10))[s:e], chr(10))) FROM c2 JOIN plain USING (doc_id)""")
def chunk_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_files(_prose(spark, sf_dir), RULES).select(*_CHUNK_COLUMNS, F.md5(F.col("content").cast("binary")).alias("content_md5"))


# ---- index


def _index_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).withColumns({"language": F.coalesce(language(F.col("name")), F.lit("unknown")), "index_name": F.element_at("parts", 1)})


def _chunked(docs: DataFrame, *more: str, by: Embedder | None = None) -> DataFrame:
    rows = chunking.chunk_lines(docs, ["index_name", "doc_id", "path", "language", *more], by=by)
    return rows.withColumns({"chunk_type": F.lit("text"), "chunk_id": index.chunk_id(F.col("index_name"), F.col("path"), F.col("chunk_no"))})


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunked(_index_files(spark, sf_dir))


@query(f"{INDEX} SELECT sha256(index_name || ':' || path || ':' || chunk_no) AS chunk_id, regexp_extract(path, '([^/]*)$', 1) || '_' || start_line || '_' || end_line || '_' || chunk_no AS chunk_label FROM idx")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.chunk_labels(_index(spark, sf_dir)).select("chunk_id", "chunk_label")


@query(f"""{INDEX} SELECT path || '#' || chunk_no AS chunk, 'path' AS k, path AS v FROM idx UNION ALL SELECT path || '#' || chunk_no, 'start_line', start_line::VARCHAR FROM idx
UNION ALL SELECT path || '#' || chunk_no, 'end_line', end_line::VARCHAR FROM idx UNION ALL SELECT path || '#' || chunk_no, 'chunk_type', 'text' FROM idx
UNION ALL SELECT path || '#' || chunk_no, 'language', language FROM idx UNION ALL SELECT path || '#' || chunk_no, 'meta_sql', path FROM idx WHERE language = 'sql'""")
def chunk_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _index(spark, sf_dir).withColumn("sql_path", F.when(F.col("language") == "sql", F.col("path")))
    return index.chunk_metadata(rows, {"sql": "sql_path"}).select(F.concat_ws("#", "path", F.col("chunk_no").cast("string")).alias("chunk"), F.explode("metadata").alias("k", "v"))


CREATED = "2024-01-01 00:00:00"


def _indexed(docs: DataFrame, *more: str) -> DataFrame:
    """Chunks of files with their vectors, as an index stores them."""
    return index.stamped(_chunked(index.by_key(docs), *more, by=hashing_embedder(64)), CREATED)


def _root(spark: SparkSession, sf_dir: str) -> str:
    """The stored index of all documents. It is written once, with its vectors; listings and searches read it."""
    build = lambda root: index.write_index(_indexed(_index_files(spark, sf_dir)), root, unique=True, sketched=("path", "content"), posted=("language", "index_name"))
    return index.built_once(spark, f"{sf_dir}/documents.parquet", build, "corpus")


def stored_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.open_index(spark, _root(spark, sf_dir))


@query(f"{INDEX} SELECT path, chunk_no, start_line, end_line, length(content) AS n_chars, 64 AS dim FROM idx WHERE index_name = 'src3'")
def index_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_dir(spark)
    index.write_index(_indexed(_index_files(spark, sf_dir)), root, unique=True)
    return index.open_index(spark, root, "src3").select("path", "chunk_no", "start_line", "end_line", F.length("content").alias("n_chars"), F.size("embedding").alias("dim"))


@query(f"{INDEX} SELECT index_name, language, count(*) AS chunks FROM idx GROUP BY ALL")
def append_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of Python files first, then all: what was there isn't added again."""
    root, rows = scratch_dir(spark), index.stamped(_index(spark, sf_dir), CREATED)
    index.write_index(rows.where("language = 'python'"), root)
    index.write_index(rows, root, "append_new")
    return index.open_index(spark, root).groupBy("index_name", "language").agg(F.count("*").alias("chunks"))


_EDITED_INDEX = INDEX.replace("FROM documents)", "FROM edited)").removeprefix("WITH RECURSIVE ")
EDITED = """WITH RECURSIVE edited AS (
  SELECT doc_id, source, lang, CASE WHEN doc_id % 9 = 0 THEN 'new first line' || chr(10) || text ELSE text END AS text FROM documents WHERE doc_id % 9 <> 3),
"""


@query(f"{EDITED}{_EDITED_INDEX} SELECT index_name, path, chunk_no, start_line, end_line, md5(content) AS content_md5, 64 AS dim FROM idx")
def upsert_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index all documents, then again after a ninth was edited, a ninth removed and a ninth had been missing: what is stored
    equals a fresh build. Only what changed is chunked and embedded."""
    root, docs = scratch_dir(spark), _index_files(spark, sf_dir)
    build = lambda new: _indexed(new, "source_digest")
    index.upsert(docs.where("doc_id % 9 <> 6"), root, build)
    text = F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("new first line\n"), F.col("text"))).otherwise(F.col("text"))
    index.upsert(docs.where("doc_id % 9 <> 3").withColumn("text", text), root, build)
    return index.open_index(spark, root).select("index_name", "path", "chunk_no", "start_line", "end_line", F.md5(F.col("content").cast("binary")).alias("content_md5"), F.size("embedding").alias("dim"))


@query(f"""{INDEX}, n AS (SELECT doc_id % 9 AS k, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY ALL)
SELECT (SELECT coalesce(sum(n), 0)::BIGINT FROM n WHERE k IN (0, 6)) AS added_files, (SELECT coalesce(sum(n), 0)::BIGINT FROM n WHERE k IN (0, 3)) AS removed_files,
       (SELECT coalesce(sum(n), 0)::BIGINT FROM n WHERE k NOT IN (0, 3, 6)) AS kept_files, 0::BIGINT AS added_again""")
def upsert_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an upsert of an edited corpus does, and that a second one does nothing."""
    root, docs = scratch_dir(spark), _index_files(spark, sf_dir)
    build = lambda new: index.stamped(_chunked(index.by_key(new), "source_digest"), CREATED)
    index.upsert(docs.where("doc_id % 9 <> 6"), root, build)
    text = F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("new first line\n"), F.col("text"))).otherwise(F.col("text"))
    edited = docs.where("doc_id % 9 <> 3").withColumn("text", text)
    done, again = index.upsert(edited, root, build), index.upsert(edited, root, build)
    return spark.createDataFrame([(done["added_files"], done["removed_files"], done["kept_files"], again["added_files"] + again["removed_files"])], "added_files bigint, removed_files bigint, kept_files bigint, added_again bigint")


@query(f"{INDEX} SELECT index_name, count(*) AS chunks FROM idx WHERE index_name <> 'src3' GROUP BY ALL")
def drop_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_dir(spark)
    index.write_index(index.stamped(_index(spark, sf_dir), CREATED), root)
    index.drop_index(spark, root, "src3")
    return index.open_index(spark, root).groupBy("index_name").agg(F.count("*").alias("chunks"))


@query(f"{INDEX} SELECT index_name, count(*) AS chunks, sum(strlen(content) + 8 * 64)::BIGINT AS storage_bytes, '2024-01-01 00:00:00' AS created, 'ok' AS status FROM idx GROUP BY ALL")
def list_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.listing(spark, _root(spark, sf_dir))


@query(f"{INDEX} SELECT index_name, count(*) AS chunks, count(DISTINCT path) AS files, count(DISTINCT language) AS languages FROM idx GROUP BY ALL")
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.counts(spark, _root(spark, sf_dir))


@query(f"{INDEX}, s AS (SELECT * FROM idx ORDER BY path, chunk_no LIMIT 1000) SELECT count(DISTINCT path) AS files, count(DISTINCT language) AS languages, count(*) AS chunks FROM s")
def index_stats_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = index.first_chunks(stored_index(spark, sf_dir).select("path", "chunk_no", "language"))
    return first.agg(F.count_distinct("path").alias("files"), F.count_distinct("language").alias("languages"), F.count("*").alias("chunks"))


CHUNK_FILTER = {
    "$and": [
        {"language": {"$ne": "sql", "$nin": ["markdown", "other"]}},
        {"$or": [{"index_name": "src1"}, {"index_name": {"$in": ["src2", "src3"]}}, {"chunk_no": {"$gt": 2, "$lte": 9}}, {"author": "nobody"}]},
        {"start_line": {"$gte": 2}, "end_line": {"$lt": 400}},
    ]
}


@query(f"""{INDEX} SELECT path, chunk_no FROM idx WHERE language NOT IN ('sql', 'markdown', 'other') AND (index_name IN ('src1', 'src2', 'src3') OR (chunk_no > 2 AND chunk_no <= 9) OR doc_id % 7 = 0)
  AND start_line >= 2 AND end_line < 400""")
def filtered_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter tree with every operator, over columns and a metadata map."""
    named = F.when(F.col("doc_id") % 7 == 0, F.create_map(F.lit("author"), F.lit("nobody"), F.lit("id"), F.col("doc_id").cast("string")))
    chunks = stored_index(spark, sf_dir).withColumn("metadata", named)
    return chunks.where(condition(chunks, CHUNK_FILTER)).select("path", "chunk_no")


POSTED_FILTER = {"$or": [{"index_name": {"$in": ["src1", "src4"]}, "language": {"$ne": "sql"}}, {"index_name": "src7", "language": {"$gte": "python"}}]}
_POSTED = "(index_name IN ('src1', 'src4') AND language <> 'sql') OR (index_name = 'src7' AND language >= 'python')"


@query(f"{INDEX} SELECT path, chunk_no FROM idx WHERE {_POSTED}")
def filtered_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the stored index that meet a filter tree; only files that have some are read."""
    return index.open_index(spark, _root(spark, sf_dir), where=POSTED_FILTER).select("path", "chunk_no")


@query(f"{INDEX} SELECT index_name, count(*) AS chunks FROM idx WHERE {_POSTED} GROUP BY ALL")
def filtered_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows meet it, from the bitmaps alone."""
    return index.matches(spark, _root(spark, sf_dir), POSTED_FILTER).groupBy("index_name").agg(F.sum(F.bitmap_count("bits")).alias("chunks"))


@query(f"{INDEX} SELECT language, count(*) AS chunks FROM idx GROUP BY ALL")
def language_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.languages(spark, _root(spark, sf_dir))


@query(f"{INDEX} SELECT (SELECT count(*) FROM files) AS files, (SELECT round(sum(size) / 1048576.0, 6) FROM files) AS total_mb, count(*) AS chunks, count(DISTINCT path) AS indexed_files, count(DISTINCT language) AS languages FROM idx")
def index_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = stats.corpus_stats(files(spark, sf_dir), MAX_FILE_BYTES).select(F.lit(1).alias("one"), F.col("total_files").alias("files"), "total_mb")
    rows = stored_index(spark, sf_dir).agg(F.lit(1).alias("one"), F.count("*").alias("chunks"), F.count_distinct("path").alias("indexed_files"), F.count_distinct("language").alias("languages"))
    return own.join(rows.hint("merge"), "one").drop("one")


@query(f"""{INDEX} SELECT index_name, 'path' AS column, count(DISTINCT path) AS exact, true AS is_near FROM idx GROUP BY ALL
UNION ALL SELECT index_name, 'content', count(DISTINCT content), true FROM idx GROUP BY ALL
UNION ALL SELECT 'all', 'path', count(DISTINCT path), true FROM idx UNION ALL SELECT 'all', 'content', count(DISTINCT content), true FROM idx""")
def distinct_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct paths and contents of each index and of all by merged sketches, within 3 % (of few: 3) of the exact counts."""
    root = _root(spark, sf_dir)
    rows = stored_index(spark, sf_dir).select("index_name", "path", F.sha2("content", 256).alias("content"))
    both = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("v")) for c in ("path", "content")])).alias("x")
    exact = rows.select("index_name", both).unionByName(rows.select(F.lit("all").alias("index_name"), both)).groupBy("index_name", "x.column").agg(F.count_distinct("x.v").alias("exact"))
    near = index.distinct_estimates(spark, root).unionByName(index.distinct_estimates(spark, root, False).withColumn("index_name", F.lit("all")))
    joined = exact.join(near.hint("merge"), ["index_name", "column"])
    return joined.select("index_name", "column", "exact", (F.abs(F.col("estimate") - F.col("exact")) <= F.greatest(F.lit(3.0), 0.03 * F.col("exact"))).alias("is_near"))


@query(f"{INDEX} SELECT path, chunk_no, length(content) AS n_chars, language FROM idx ORDER BY path, chunk_no LIMIT 100")
def browse_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.page(spark, _root(spark, sf_dir), 100).select("path", "chunk_no", F.length("content").alias("n_chars"), "language")


@query(f"{INDEX} SELECT path, chunk_no, length(content) AS n_chars, language FROM idx WHERE path > 'src15' ORDER BY path, chunk_no LIMIT 100")
def browse_next_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page after a key; files that end before it or begin after the page aren't opened."""
    return index.page(spark, _root(spark, sf_dir), 100, ("src15", 0)).select("path", "chunk_no", F.length("content").alias("n_chars"), "language")


@query("""WITH l AS (SELECT 'conv' || conv_id AS index_name, turn AS run_id, turn AS updated_at, CASE WHEN length(text) % 7 = 0 THEN 'cleared' WHEN role = 'user' THEN 'indexing' ELSE 'completed' END AS status, length(text) AS chunks_count FROM conversations)
SELECT index_name, run_id, status, chunks_count FROM l QUALIFY row_number() OVER (PARTITION BY index_name ORDER BY updated_at DESC, run_id DESC) = 1 AND status <> 'cleared'""")
def run_ledger_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns stand for runs: the latest of each conversation, unless it was cleared."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    status = F.when(F.length("text") % 7 == 0, "cleared").when(F.col("role") == "user", "indexing").otherwise("completed")
    ledger = c.select(F.concat(F.lit("conv"), F.col("conv_id").cast("string")).alias("index_name"), F.col("turn").alias("run_id"), F.col("turn").alias("updated_at"), status.alias("status"), F.length("text").alias("chunks_count"))
    return index.latest_runs(ledger).select("index_name", "run_id", "status", "chunks_count")


@query(f"{INDEX}, r AS (SELECT count(*) AS chunks_count, count(DISTINCT path) AS files_count FROM idx WHERE index_name = 'src3') SELECT 'src3' AS index_name, 'completed' AS status, files_count, chunks_count FROM r")
def run_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index one source with its run in the ledger, then read the current row."""
    own = _index(spark, sf_dir).where("index_name = 'src3'")
    ledger = scratch_dir(spark)
    n_files = own.select("path").distinct().count()
    index.index_run(index.stamped(own, CREATED), scratch_dir(spark), ledger, n_files)
    return index.latest_runs(spark.read.schema(index.LEDGER).parquet(ledger)).select("index_name", "status", F.col("files_count").cast("long").alias("files_count"), "chunks_count")


@query(f"{INDEX} SELECT path || '#' || chunk_no AS chunk, 'sql' AS k, path AS v FROM idx WHERE language = 'sql'")
def metadata_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _index(spark, sf_dir).withColumn("sql_path", F.when(F.col("language") == "sql", F.col("path")))
    return index.chunk_metadata(rows, {"sql": "sql_path"}).select(F.concat_ws("#", "path", F.col("chunk_no").cast("string")).alias("chunk"), F.explode(index.shown_metadata(F.col("metadata"))).alias("k", "v"))


@query("SELECT doc_id, label, len(embedding) AS dim FROM documents JOIN embeddings ON doc_id = vec_id")
def attach_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumnRenamed("vec_id", "doc_id")
    return index.attach_vectors(docs, vectors, "doc_id", missing="drop").select("doc_id", "label", F.size("embedding").alias("dim"))


# ---- embedders and search


@query(f"WITH {hashed('h', 'doc_id', 'text', 'documents')} SELECT doc_id, b AS dim, round(v, 6) AS value FROM h")
def embed_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").alias("content"))
    long = embed(docs, hashing_embedder(64), precise=True).select("doc_id", F.posexplode("embedding").alias("dim", "value"))
    return long.where("value <> 0").select("doc_id", F.col("dim").cast("long").alias("dim"), F.round("value", 6).alias("value"))


def letters_embedder() -> Embedder:
    """A plug-in: shares of the letters a-z."""

    def make():
        def run(texts: list[str]) -> np.ndarray:
            return np.array([[t.lower().count(c) / max(len(t), 1) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts])

        return run

    return Embedder("letters", make, 26)


@query("SELECT doc_id, round((length(text) - length(replace(lower(text), 'e', ''))) / greatest(length(text), 1), 6) AS share_of_e FROM documents")
def embed_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").alias("content"))
    return embed(docs, letters_embedder(), precise=True).select("doc_id", F.round(F.col("embedding")[4], 6).alias("share_of_e"))


@query("SELECT strpos(text, ' | ') = 0 AS embed_ok, count(*) AS n FROM documents GROUP BY ALL")
def embed_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model that fails on tables, called text by text: failures are counted, not lost."""

    def make():
        inner = hashing_embedder(64).make()

        def run(texts: list[str]) -> np.ndarray:
            if any(" | " in t for t in texts):
                raise RuntimeError("no tables")
            return inner(texts)

        return run

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").alias("content"))
    return embed(docs, Embedder("picky", make, 64), batch=1).groupBy("embed_ok").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n_rows, count(*) FILTER (regexp_matches(text, '[\\p{L}\\p{N}]')) AS n_texts, true AS directions_are_orthonormal, true AS lengths_are_one_or_zero FROM documents")
def embed_fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An embedder fitted on all documents, and every document embedded by it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").alias("content"))
    rows = fitted.counted(docs)
    rarity, projection = fitted.fit(docs, 64, rows=rows)
    vectors_of = embed(docs, fitted.fitted_embedder("fitted64", rarity, projection), precise=True)
    length = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    n_texts = fitted.document_counts(rows)[0]
    fine = bool(np.allclose(projection.T @ projection, np.eye(64), atol=1e-8))
    return vectors_of.agg(F.count("*").alias("n_rows"), F.lit(n_texts).cast("long").alias("n_texts"), F.lit(fine).alias("directions_are_orthonormal"), F.bool_and((F.abs(length - 1) < 1e-9) | (length == 0)).alias("lengths_are_one_or_zero"))


@query("""WITH d AS (SELECT DISTINCT coalesce(text, '') AS t FROM documents), n AS (SELECT count(*) AS n, count(*) FILTER (strpos(t, ' | ') > 0) AS bad FROM d)
SELECT n AS first_run, bad AS second_run, bad AS healed_run, 0::BIGINT AS last_run, (SELECT count(*) FROM documents) AS good_rows FROM n""")
def embed_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many contents each run embeds: all, those that failed, the same by a model that heals, none."""
    docs, root = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").alias("content")), scratch_dir(spark)

    def make():
        inner = hashing_embedder(64).make()

        def run(texts: list[str]) -> np.ndarray:
            if any(" | " in t for t in texts):
                raise RuntimeError("no tables")
            return inner(texts)

        return run

    picky, healed = Embedder("model", make, 64), Embedder("model", hashing_embedder(64).make, 64)
    runs = [vectors.embed_missing(docs, by, root, batch=1) for by in (picky, picky, healed, healed)]
    stored = vectors.embed_stored(docs, healed, root)
    return stored.agg(*[F.lit(n).cast("long").alias(c) for n, c in zip(runs, ("first_run", "second_run", "healed_run", "last_run"))], F.count_if("embed_ok").alias("good_rows"))


_L2 = "list_sum([(a.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE) ** 2 for i in range(1, 65)])"
_IP = "list_sum([a.embedding[i]::DOUBLE * q.embedding[i]::DOUBLE for i in range(1, 65)])"


def _knn(distance: str, k: str, where: str = "true") -> str:
    return f"""WITH d AS (SELECT q.vec_id AS query_id, a.vec_id AS id, round({distance}, 6) + 0.0 AS distance, {k} AS k
  FROM embeddings a, embeddings q WHERE q.vec_id % 100 = 0 AND {where})
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank, id, distance FROM d
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, id) <= any_value(k) OVER (PARTITION BY query_id)"""


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All vectors, and as queries those whose id is divisible by 100."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return v, v.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")


@query(_knn(_L2, "10"))
def knn_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, q = _vectors(spark, sf_dir)
    return search.nearest(v, q, 10, "l2sq", "vec_id")


@query(_knn(f"1 - {_IP} / (sqrt(list_sum([a.embedding[i]::DOUBLE ** 2 for i in range(1, 65)])) * sqrt(list_sum([q.embedding[i]::DOUBLE ** 2 for i in range(1, 65)])))", "5"))
def knn_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, q = _vectors(spark, sf_dir)
    return search.nearest(v, q, 5, "cosine", "vec_id")


@query(_knn(f"1 - {_IP}", "10", "(a.label IN (1, 3, 5) AND a.label <> 3 OR a.label >= 8)"))
def knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, q = _vectors(spark, sf_dir)
    tree = {"$or": [{"label": {"$in": [1, 3, 5], "$ne": 3}}, {"label": {"$gte": 8}}]}
    return search.nearest(v, q, 10, "ip", "vec_id", where=tree)


@query(_knn(_L2, "least(greatest(q.label * 5 - 2, 1), 20)"))
def knn_per_query_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, q = _vectors(spark, sf_dir)
    return search.nearest(v, q.withColumn("k", F.col("label") * 5 - 2), "k", "l2sq", "vec_id")


@query()
def knn_ivf(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, q = _vectors(spark, sf_dir)
    root = scratch_dir(spark)
    centroids = search.write_lists(v, root, id_col="vec_id")
    return search.nearest_ivf(spark, root, centroids, q, 10, search.probes_for(v, centroids, id_col="vec_id"), id_col="vec_id")


@query("SELECT count(*) AS n_queries, true AS recall_is_enough, true AS distances_are_true FROM embeddings WHERE vec_id % 100 = 0")
def knn_ivf_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The approximate search against the exact one: recall of at least 0.9, and no distance that isn't exact."""
    near = knn_ivf(spark, sf_dir).select("query_id", "id", F.col("distance").alias("d"))
    both = knn_exact(spark, sf_dir).join(near.hint("merge"), ["query_id", "id"], "left")
    per_query = both.groupBy("query_id").agg(F.count("*").alias("n"), F.count("d").alias("found"), F.count_if(F.abs(F.col("d") - F.col("distance")) > 2e-6).alias("wrong"))
    return per_query.agg(F.count("*").alias("n_queries"), (F.sum("found") >= 0.9 * F.sum("n")).alias("recall_is_enough"), (F.sum("wrong") == 0).alias("distances_are_true"))


@query(_knn(_L2, "5").replace("q.vec_id % 100 = 0 AND ", ""))
def knn_join_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors of every vector, exactly."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return knn_join.knn_join(v.select(F.col("vec_id").alias("query_id"), "embedding"), v, 5, "vec_id")[0]


def _quantized(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, str, quantized.Quantizer, int, int]:
    v, q = _vectors(spark, sf_dir)
    root, model = scratch_dir(spark), quantized.train(v)
    quantized.write_quantized(v, root, model, "vec_id")
    return v, q, root, model, *quantized.calibrate(spark, root, model, 10, 0.99, id_col="vec_id")


@query()
def knn_quantized(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, q, root, model, shortlist, n_probe = _quantized(spark, sf_dir)
    return quantized.nearest_quantized(spark, root, model, q, 10, shortlist, n_probe, "vec_id")


@query("SELECT count(*) AS n_queries, true AS recall_is_enough, true AS distances_are_true, true AS reads_a_quarter FROM embeddings WHERE vec_id % 100 = 0")
def knn_quantized_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of at least 0.9 against the exact search, true distances, and for a query no more than a quarter of the bytes
    of all vectors: codes of the probed lists (at most all) and the vectors of its shortlist."""
    v, q, root, model, shortlist, n_probe = _quantized(spark, sf_dir)
    near = quantized.nearest_quantized(spark, root, model, q, 10, shortlist, n_probe, "vec_id").select("query_id", "id", F.col("distance").alias("d"))
    both = search.nearest(v, q, 10, "l2sq", "vec_id").join(near.hint("merge"), ["query_id", "id"], "left")
    per_query = both.groupBy("query_id").agg(F.count("*").alias("n"), F.count("d").alias("found"), F.count_if(F.abs(F.col("d") - F.col("distance")) > 2e-6).alias("wrong"))
    rows, vector_bytes = v.count(), 4 * model.centroids.shape[1]
    share = (rows * model.parts + shortlist * vector_bytes) / (rows * vector_bytes)
    return per_query.agg(F.count("*").alias("n_queries"), (F.sum("found") >= 0.9 * F.sum("n")).alias("recall_is_enough"), (F.sum("wrong") == 0).alias("distances_are_true"), F.lit(share <= 0.25).alias("reads_a_quarter"))


@query(f"SELECT query_id, rank, id, round(greatest(0.0, 1 - distance), 6) AS similarity FROM ({_knn(_L2, '10')})")
def similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn_exact(spark, sf_dir).select("query_id", "rank", "id", F.round(search.similarity(F.col("distance")), 6).alias("similarity"))


@query(f"{INDEX} SELECT path, chunk_no, md5(CASE WHEN length(content) > 500 THEN substr(content, 1, 500) || chr(10) || '... (truncated)' ELSE content END) AS preview_md5 FROM idx")
def result_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_index(spark, sf_dir).select("path", "chunk_no", F.md5(search.preview(F.col("content")).cast("binary")).alias("preview_md5"))


_SEARCH = f"""{INDEX},
texts AS (SELECT *, sha256(index_name || ':' || path || ':' || chunk_no) AS chunk_id FROM idx),
{hashed('h', 'chunk_id', 'content', 'texts')},
{hashed('g', 'item_id', 'text', 'benchmark')},
dots AS (SELECT g.item_id, h.chunk_id, sum(g.v * h.v) AS dot FROM g JOIN h USING (b) GROUP BY ALL),
sizes AS (SELECT t.chunk_id, coalesce(x.n, 0) AS n FROM texts t LEFT JOIN (SELECT chunk_id, sum(v * v) AS n FROM h GROUP BY ALL) x USING (chunk_id)),
qs AS (SELECT t.item_id, coalesce(x.n, 0) AS n FROM benchmark t LEFT JOIN (SELECT item_id, sum(v * v) AS n FROM g GROUP BY ALL) x USING (item_id)),
far AS (SELECT qs.item_id AS query_id, sizes.chunk_id AS id, abs(round(qs.n + sizes.n - 2 * coalesce(dot, 0), 6)) AS distance
        FROM qs CROSS JOIN sizes LEFT JOIN dots ON dots.item_id = qs.item_id AND dots.chunk_id = sizes.chunk_id),
hits AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank, id, distance FROM far
         QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, id) <= 5)"""


def _search(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, int]:
    """The 5 nearest chunks of every benchmark text, the stored chunks, and how many hits there are at most."""
    chunks = stored_index(spark, sf_dir)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("content"))
    return search.nearest(chunks.where("embed_ok"), embed(items, hashing_embedder(64), precise=True), 5), chunks, 5 * items.count()


@query(f"{_SEARCH} SELECT query_id, rank, path, start_line, end_line, distance, round(greatest(0.0, 1 - distance), 6) AS similarity FROM hits JOIN texts ON id = chunk_id")
def search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: every text chunked, embedded and stored, find the 5 nearest chunks of every benchmark text."""
    hits, chunks, most = _search(spark, sf_dir)
    return search.with_chunks(hits, chunks.select("chunk_id", "path", "start_line", "end_line"), most).select("query_id", "rank", "path", "start_line", "end_line", "distance", F.round(search.similarity(F.col("distance")), 6).alias("similarity"))


@query(f"""{_SEARCH} SELECT query_id, rank, regexp_extract(path, '([^/]*)$', 1) AS file_name, path, start_line || '-' || end_line AS lines, 'text' AS chunk_type, language,
  round(greatest(0.0, 1 - distance), 6) AS similarity, CASE WHEN length(content) > 500 THEN substr(content, 1, 500) || chr(10) || '... (truncated)' ELSE content END AS preview FROM hits JOIN texts ON id = chunk_id""")
def result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits, chunks, most = _search(spark, sf_dir)
    return search.result_rows(hits, chunks, most)
