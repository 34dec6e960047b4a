"""Named vector indexes: one versioned table of chunks (``snapshots``), partitioned by index_name.

Writes publish a new version; listings and counts read the newest one and no chunk.
"""

from __future__ import annotations

import datetime
import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.conditions import condition
from quarry.functions.scratch import scratch_dir
from quarry.operators import snapshots


def chunk_id(index_name: Column, path: Column, chunk_no: Column) -> Column:
    """The key of a chunk; it doesn't depend on the order of a walk."""
    return F.sha2(F.concat_ws(":", index_name, path, chunk_no.cast("string")), 256)


def chunk_labels(df: DataFrame, path_col: str = "path") -> DataFrame:
    """Readable labels name_start_end_i, with i the chunk's place (from 0) in its file."""
    return df.withColumn("chunk_label", F.concat_ws("_", F.element_at(F.split(path_col, "/"), -1), F.col("start_line").cast("string"), F.col("end_line").cast("string"), F.col("chunk_no").cast("string")))


def chunk_metadata(df: DataFrame, extra: dict[str, str]) -> DataFrame:
    """A string map of the chunk's fields; of ``extra`` (key -> column) those that aren't null, as meta_key."""
    base = F.create_map(*[x for c in ("path", "start_line", "end_line", "chunk_type", "language") for x in (F.lit(c), F.col(c).cast("string"))])
    more = F.create_map(*[x for k, c in extra.items() for x in (F.lit(k), F.col(c).cast("string"))])
    more = F.transform_keys(F.map_filter(more, lambda k, v: v.isNotNull()), lambda k, v: F.concat(F.lit("meta_"), k))
    return df.withColumn("metadata", F.map_concat(base, more))


def shown_metadata(metadata: Column) -> Column:
    """The extra fields of a chunk's metadata, under their own keys."""
    return F.transform_keys(F.map_filter(metadata, lambda k, v: F.startswith(k, F.lit("meta_"))), lambda k, v: F.substring(k, 6, 1 << 30))


def stamped(chunks: DataFrame, created_at: str | None = None, content_col: str = "content", embedding_col: str = "embedding") -> DataFrame:
    """``chunks`` with storage_bytes (content and vector, as stored) and created_at, so that a listing reads neither column."""
    size = F.octet_length(content_col)
    if embedding_col in chunks.columns:
        size += F.size(embedding_col) * (8 if chunks.schema[embedding_col].dataType.simpleString() == "array<double>" else 4)
    when = F.lit(created_at).cast("timestamp") if created_at else F.current_timestamp()
    return chunks.withColumns({"storage_bytes": size.cast("long"), "created_at": when})


def content_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def by_key(files: DataFrame) -> DataFrame:
    """``files`` (index_name, path) dealt and sorted by their key: chunked in this order, an index has files with
    narrow bounds, and indexes of any size are spread evenly."""
    return files.repartitionByRange("index_name", "path").sortWithinPartitions("index_name", "path")


def write_index(chunks: DataFrame, root: str, mode: str = "replace", unique: bool = False, sketched: tuple[str, ...] = (), posted: tuple[str, ...] = ()) -> None:
    """``replace``: the index_names of ``chunks`` are replaced, others stay. ``append_new``: chunks with a chunk_id
    that the index doesn't have are added, those whose content differs from it take its place. All or nothing.
    Of chunks with one index_name and chunk_id one is stored; ``unique`` says that there are no such, and spares a shuffle. ``sketched``: columns whose distinct values ``distinct_estimates`` tells; ``posted``: columns whose values get bitmaps, for ``open_index``."""
    if mode not in ("replace", "append_new"):
        raise ValueError("mode is replace or append_new")
    spark, out = chunks.sparkSession, chunks
    before = snapshots.current(spark, root)
    schema = snapshots.merged(before.schema if before else chunks.schema, chunks.schema)
    if not unique:  # a task gets whole parts of indexes, so that an index has few files; copies of a chunk are in one part
        part = F.pmod(F.xxhash64("chunk_id"), F.lit(int(spark.conf.get("spark.sql.shuffle.partitions", "200"))))
        out = out.withColumn("_part", part).repartition("index_name", "_part").dropDuplicates(["index_name", "_part", "chunk_id"]).drop("_part")
    if mode == "append_new" and before:
        out = new_chunks(out, snapshots.rows(spark, root, before))
    added = snapshots.add_segment(root, out, sketched, posted)
    after = before or snapshots.Version(0, schema)
    if mode == "append_new" and before and added:
        # what was there under an added id
        names = [e.index_name for e in added]
        fresh = snapshots.rows(spark, root, snapshots.Version(0, schema, added)).select("index_name", "chunk_id")
        held = snapshots.rows(spark, root, before, names, positions=True)
        after = snapshots.drop_rows(root, before, held.join(fresh.hint("merge"), ["index_name", "chunk_id"], "left_semi"))
    replaced = {e.index_name for e in added} if mode == "replace" else set()
    kept = [e for e in after.entries if e.index_name not in replaced and e.chunks]
    snapshots.publish(spark, root, snapshots.Version(after.number + 1, schema, kept + added, after.dropped))


def new_chunks(chunks: DataFrame, index: DataFrame) -> DataFrame:
    """Chunks that the index doesn't have: no such id, or other content under it."""
    known = index.select("index_name", "chunk_id", content_digest(F.col("content")).alias("_content"))
    keyed = chunks.withColumn("_content", content_digest(F.col("content")))
    return keyed.join(known.hint("merge"), ["index_name", "chunk_id", "_content"], "left_anti").drop("_content").select(*chunks.columns)


def upsert(files: DataFrame, root: str, build: Callable[[DataFrame], DataFrame], complete: bool = True) -> dict[str, int]:
    """Bring the indexes of ``files`` (index_name, path, text, more) up to date. Only files that the index doesn't have with
    this text are chunked and embedded, by ``build``, which gets them with source_digest and keeps index_name, path, chunk_no
    and source_digest. Chunks of changed files are dropped, and of files that are gone if ``files`` is ``complete``. All or
    nothing; a run that is repeated changes nothing. Files without text have no chunks; of files with one path the
    one with the least digest counts. Returns how many files were added (new or changed), removed (gone or changed) and kept.

    Digests alone are compared, in both directions, by joins that can spill; texts are read again for new files only."""
    spark = files.sparkSession
    digested = files.withColumn("source_digest", content_digest(F.col("text")))
    key = ["index_name", "path", "source_digest"]
    given = scratch_dir(spark)
    digested.where(F.col("text").isNotNull()).groupBy("index_name", "path").agg(F.min("source_digest").alias("source_digest")).write.parquet(given)
    given = spark.read.parquet(given)
    before = snapshots.current(spark, root)
    names = [r[0] for r in files.select("index_name").distinct().collect()]
    if before:
        held = snapshots.rows(spark, root, before, names, positions=True)
        known = held.where("chunk_no = 0").select(*key)
        new_at, gone_at = scratch_dir(spark), scratch_dir(spark)
        given.join(known.hint("merge"), key, "left_anti").write.parquet(new_at)
        gone = known.join(given.hint("merge"), key, "left_anti")
        if not complete:  # a file that isn't given stays
            gone = gone.join(given.select("index_name", "path").hint("merge"), ["index_name", "path"], "left_semi")
        gone.write.parquet(gone_at)
        new, gone = spark.read.schema(given.schema).parquet(new_at), spark.read.schema(given.schema).parquet(gone_at)
        n_new, n_gone = new.count(), gone.count()
    else:
        new, gone, n_new, n_gone = given, None, given.count(), 0
    kept_files = given.count() - n_new
    if not n_new and not n_gone:
        return {"added_files": 0, "removed_files": 0, "kept_files": kept_files}
    after, added, schema = before, [], before.schema if before else None
    if n_new:
        few = n_new <= snapshots.BROADCAST_POSITIONS
        chunks = build(digested.join(new.hint("broadcast" if few else "merge"), key, "left_semi").dropDuplicates(["index_name", "path"]))
        schema = snapshots.merged(schema or chunks.schema, chunks.schema)
        added = snapshots.add_segment(root, chunks)
        after = after or snapshots.Version(0, schema)
    if n_gone:
        few = n_gone <= snapshots.BROADCAST_POSITIONS
        after = snapshots.drop_rows(root, after, held.join(gone.hint("broadcast" if few else "merge"), key, "left_semi"))
    snapshots.publish(spark, root, snapshots.Version(after.number + 1, schema, [e for e in after.entries if e.chunks] + added, after.dropped))
    return {"added_files": n_new, "removed_files": n_gone, "kept_files": kept_files}


def compact(spark: SparkSession, root: str, name: str) -> None:
    """One index as one segment without dropped rows, ordered by path."""
    write_index(open_index(spark, root, name).repartitionByRange("path", "chunk_no").sortWithinPartitions("path", "chunk_no"), root, unique=True)


LEDGER = "run_id string, index_name string, status string, files_count int, size_mb double, chunks_count bigint, updated_at timestamp"


def record_run(spark: SparkSession, ledger: str, run_id: str, index_name: str, status: str, files_count: int | None = None, size_mb: float | None = None, chunks_count: int | None = None) -> None:
    """Append a row to the ledger of runs."""
    now = datetime.datetime.now(datetime.timezone.utc)
    spark.createDataFrame([(run_id, index_name, status, files_count, size_mb, chunks_count, now)], LEDGER).coalesce(1).write.mode("append").parquet(ledger)


def index_run(chunks: DataFrame, root: str, ledger: str, files_count: int | None = None, size_mb: float | None = None, mode: str = "replace") -> None:
    """``write_index`` of one index_name, with its status in the ledger: indexing, then completed with counts, or failed."""
    spark, run_id = chunks.sparkSession, uuid.uuid4().hex
    name = chunks.select("index_name").first()
    if name is None:
        raise ValueError("no chunks to index")
    record_run(spark, ledger, run_id, name[0], "indexing", files_count, size_mb)
    try:
        write_index(chunks, root, mode)
    except Exception:
        record_run(spark, ledger, run_id, name[0], "failed", files_count, size_mb)
        raise
    record_run(spark, ledger, run_id, name[0], "completed", files_count, size_mb, sum(e.chunks for e in snapshots.current(spark, root).entries if e.index_name == name[0]))


def built_once(spark: SparkSession, source: str, build: Callable[[str], None], name: str = "built") -> str:
    """The folder that ``build(folder)`` wrote from the files at ``source``, built again only after a change of
    these (names, sizes, times) or in another application."""
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    state = sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(path))
    key = hashlib.sha256(repr((spark.sparkContext.applicationId, state)).encode()).hexdigest()[:24]
    root = scratch_dir(spark, f"{name}-{key}")
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{root}.done")
    if not snapshots.exists(spark, done.toString()):
        build(root)
        done.getFileSystem(spark._jsc.hadoopConfiguration()).create(done).close()
    return root


def _version(spark: SparkSession, root: str) -> snapshots.Version:
    version = snapshots.current(spark, root)
    if version is None:
        raise ValueError(f"no index table at {root}")
    return version


def _known(version: snapshots.Version, name: str) -> str:
    if name not in version.names():
        raise ValueError(f"no index {name!r}; there are: {', '.join(version.names())}")
    return name


KEY = ["seg", "index_name", "file", "bucket"]


def matches(spark: SparkSession, root: str, tree: dict, name: str | None = None) -> DataFrame | None:
    """(seg, index_name, file, bucket, bits): bitmaps of the rows that can meet a filter tree, from the posted columns
    alone; what concerns other columns may hold for any row. None: any row of any file can meet it. Where all of the tree
    concerns posted columns and nothing was dropped, the bits are exactly the rows that meet it."""
    version = _version(spark, root)
    held = snapshots.postings(spark, root, version, None if name is None else [name])
    if held is None:
        return None
    known = {r[0] for r in held.select("column").distinct().collect()}  # columns, a few

    def rows_of(tree: dict) -> DataFrame | None:
        parts = []
        for key, value in tree.items():
            op = key.removeprefix("$")
            if op in ("and", "or") and isinstance(value, list | tuple):
                parts.append(joined([rows_of(t) for t in value], op))
            elif key in known:
                own = held.where(F.col("column") == key).withColumn(key, F.col("value").cast(version.schema[key].dataType))
                parts.append(own.where(condition(own, {key: value})).groupBy(*KEY).agg(F.bitmap_or_agg("bits").alias("bits")))
            else:
                parts.append(None)
        return joined(parts, "and")

    def joined(parts: list[DataFrame | None], op: str) -> DataFrame | None:
        some = [p for p in parts if p is not None]
        if not some or (op == "or" and len(some) < len(parts)):
            return None
        out = some[0]
        for p in some[1:]:
            out = out.unionByName(p)
        if len(some) == 1:
            return out
        if op == "or":
            return out.groupBy(*KEY).agg(F.bitmap_or_agg("bits").alias("bits"))
        both = out.groupBy(*KEY).agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("n"))
        return both.where(F.col("n") == len(some)).drop("n")

    found = rows_of(tree)
    return None if found is None else found.where(F.bitmap_count("bits") > 0)


def open_index(spark: SparkSession, root: str, name: str | None = None, where: dict | None = None) -> DataFrame:
    """The table, or one index of it; a missing index is an error, never an empty result. ``where``: the rows that meet a
    filter tree; files whose bitmaps have none of them aren't read."""
    version = _version(spark, root)
    names = None if name is None else [_known(version, name)]
    table = snapshots.rows(spark, root, version, names)
    if not where:
        return table
    meets, found = condition(table, where), matches(spark, root, where, name)
    if found is not None:
        files = [r[0] for r in found.select("file").distinct().limit(snapshots.MOST_FILES + 1).collect()]
        if len(files) <= snapshots.MOST_FILES:  # more are left to the scan's own statistics
            table = snapshots.rows(spark, root, version, names, files=files)
    return table.where(meets)


def drop_index(spark: SparkSession, root: str, name: str, purge: bool = True) -> None:
    """Remove one index; a missing index is an error. ``purge`` deletes what is stored of it, else older versions keep it."""
    version = _version(spark, root)
    _known(version, name)
    snapshots.publish(spark, root, snapshots.Version(version.number + 1, version.schema, [e for e in version.entries if e.index_name != name], version.dropped))
    if purge:
        snapshots.vacuum(spark, root)


LISTED = "index_name string, chunks bigint, storage_bytes bigint, created string, status string"


def listing(spark: SparkSession, root: str) -> DataFrame:
    """Chunks, bytes, time of creation (UTC) and status of each index, from the newest version alone. An index that
    lacks a stored folder is listed as ``unreadable``, and hides no other."""
    out: dict[str, list] = {}
    for e in _version(spark, root).entries:
        row = out.setdefault(e.index_name, [0, 0, None, "ok"])
        row[0], row[1] = row[0] + e.chunks, row[1] + e.storage_bytes
        row[2] = min((x for x in (row[2], e.created) if x is not None), default=None)
        if not snapshots.exists(spark, f"{root}/data/{e.folder}"):
            row[3] = "unreadable"
    when = lambda x: None if x is None else datetime.datetime.fromtimestamp(x, datetime.timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
    return spark.createDataFrame([(name, n, size, when(created), status) for name, (n, size, created, status) in out.items()], LISTED)


def list_tables(spark: SparkSession, folder: str) -> DataFrame:
    """(table, indexes, chunks, status) of each index table below ``folder``; one that can't be read is listed as such."""
    fs, path = snapshots._path(spark, folder)
    out = []
    for f in fs.listStatus(path):
        name = f.getPath().getName()
        try:
            version = _version(spark, f"{folder}/{name}")
            out.append((name, len(version.names()), sum(e.chunks for e in version.entries), "ok"))
        except Exception as e:  # noqa: BLE001  whatever is wrong with one table must not hide the others
            out.append((name, None, None, f"unreadable: {type(e).__name__}"))
    return spark.createDataFrame(out, "table string, indexes int, chunks bigint, status string")


def counts(spark: SparkSession, root: str) -> DataFrame:
    """Chunks, files and languages of each index, from the newest version alone. A file's first chunk stands for it."""
    out: dict[str, tuple] = {}
    for e in _version(spark, root).entries:
        n, paths, languages = out.get(e.index_name, (0, 0, set()))
        out[e.index_name] = n + e.chunks, paths + e.paths, languages | {k for k, v in e.languages.items() if v}
    return spark.createDataFrame([(name, n, paths, len(languages)) for name, (n, paths, languages) in out.items()], "index_name string, chunks bigint, files bigint, languages bigint")


def languages(spark: SparkSession, root: str) -> DataFrame:
    """(language, chunks) over all indexes, from the newest version alone."""
    out: dict[str, int] = {}
    for e in _version(spark, root).entries:
        for k, v in e.languages.items():
            out[k] = out.get(k, 0) + v
    return spark.createDataFrame([(k, v) for k, v in out.items() if v], "language string, chunks bigint")


def distinct_estimates(spark: SparkSession, root: str, by_index: bool = True) -> DataFrame:
    """Estimated distinct values of the sketched columns, of each index or of all; see ``snapshots.estimates``."""
    return snapshots.estimates(spark, root, _version(spark, root), by_index)


def page(spark: SparkSession, root: str, n: int = 100, after: tuple[str, int] | None = None) -> DataFrame:
    """The next ``n`` chunks by (path, chunk_no) after a key; see ``snapshots.next_page``."""
    return snapshots.next_page(spark, root, _version(spark, root), n, after)


def attach_vectors(chunks: DataFrame, vectors: DataFrame, key: str = "chunk_id", vector_col: str = "embedding", missing: str = "error") -> DataFrame:
    """Chunks with vectors from elsewhere. A chunk without a vector is an error, or left out (``missing="drop"``)."""
    if missing == "drop":
        return chunks.join(vectors.where(F.col(vector_col).isNotNull()).hint("merge"), key)
    joined = chunks.join(vectors.hint("merge"), key, "left")
    lacks = F.raise_error(F.concat(F.lit("no vector for "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return joined.withColumn(vector_col, F.when(F.col(vector_col).isNotNull(), F.col(vector_col)).otherwise(lacks))


def list_indexes(index: DataFrame) -> DataFrame:
    """Chunks, bytes and time of creation of each index, from ``stamped`` rows."""
    return index.groupBy("index_name").agg(F.count("*").alias("chunks"), F.sum("storage_bytes").alias("storage_bytes"), F.date_format(F.min("created_at"), "yyyy-MM-dd HH:mm:ss").alias("created"))


def index_stats(index: DataFrame) -> DataFrame:
    return index.groupBy("index_name").agg(F.count("*").alias("chunks"), F.count_distinct("path").alias("files"), F.count_distinct("language").alias("languages"))


def first_chunks(index: DataFrame, n: int = 1000) -> DataFrame:
    return index.orderBy("path", "chunk_no").limit(n)


def language_histogram(index: DataFrame) -> DataFrame:
    return index.groupBy("language").agg(F.count("*").alias("chunks"))


def latest_runs(ledger: DataFrame) -> DataFrame:
    """The current row of each index in an append-only ledger; a cleared index has none."""
    w = Window.partitionBy("index_name").orderBy(F.desc("updated_at"), F.desc("run_id"))
    return ledger.withColumn("_r", F.row_number().over(w)).where("_r = 1 AND status <> 'cleared'").drop("_r")
