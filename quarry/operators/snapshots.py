"""Versions of an index table: what is stored, and which of it counts.

A write adds a segment (a folder of Parquet files, partitioned by index_name) and never touches older ones. What counts is
listed in a version: a small JSON file with an entry for each segment and index (rows, bytes, paths, languages) and the
folders of dropped positions. It is published by one rename that fails if the version exists, so readers see the old
version or the new one, a write that fails changes nothing, and of two writers at once one gets an error. Beside each
segment Spark writes a table of its data files with rows, bytes, and least and greatest key.

Dropped rows are positions (index, file, row) that reading leaves out; segments without any are read as they are. Few
positions (``BROADCAST_POSITIONS``, known from the version) go to the scan by broadcast, more by a join that can spill.

The driver holds one entry for each segment and index, never one for each file or row.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_POSITIONS = 1_000_000
KEPT_VERSIONS = 10
POSITIONS = "index_name string, file string, row bigint"
FILES = "index_name string, file string, rows bigint, least struct<path: string, chunk_no: int>, greatest struct<path: string, chunk_no: int>"
MOST_FILES = 1000  # of a page, named to the scan


@dataclass
class Entry:
    """Live contents of one index in one segment."""

    segment: str
    index_name: str
    folder: str  # below data/
    rows: int  # as stored
    dropped: int
    storage_bytes: int
    paths: int
    created: float | None
    languages: dict[str, int]

    @property
    def chunks(self) -> int:
        return self.rows - self.dropped


@dataclass
class Version:
    number: int
    schema: T.StructType
    entries: list[Entry] = field(default_factory=list)
    dropped: dict[str, int] = field(default_factory=dict)  # folders below dropped/ and how many positions each has

    def names(self) -> list[str]:
        return sorted({e.index_name for e in self.entries})


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def current(spark: SparkSession, root: str) -> Version | None:
    """The newest version, or None if there is none."""
    fs, folder = _path(spark, f"{root}/versions")
    if not fs.exists(folder):
        return None
    found = sorted(n for f in fs.listStatus(folder) if (n := f.getPath().getName()).endswith(".json"))
    if not found:
        return None
    stream = fs.open(_path(spark, f"{root}/versions/{found[-1]}")[1])
    try:
        held = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    return Version(held["number"], T.StructType.fromJson(held["schema"]), [Entry(**e) for e in held["entries"]], held["dropped"])


def publish(spark: SparkSession, root: str, version: Version) -> None:
    """Make ``version`` the newest; an error if another one with its number is there."""
    text = json.dumps({"number": version.number, "schema": version.schema.jsonValue(), "entries": [vars(e) for e in version.entries], "dropped": version.dropped})
    fs, draft = _path(spark, f"{root}/versions/.{uuid.uuid4().hex}")
    out = fs.create(draft)
    out.write(text.encode())
    out.close()
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(draft, _path(spark, f"{root}/versions/{version.number:012d}.json")[1], none)
    except Exception as e:
        fs.delete(draft, False)
        raise RuntimeError(f"version {version.number} of {root} was published by another writer") from e
    for n in range(max(0, version.number - 2 * KEPT_VERSIONS), version.number - KEPT_VERSIONS):
        fs.delete(_path(spark, f"{root}/versions/{n:012d}.json")[1], False)


def merged(old: T.StructType, new: T.StructType) -> T.StructType:
    """Fields of both; one that both have must have one type."""
    known = {f.name: f.dataType for f in old}
    for f in new:
        if known.get(f.name, f.dataType) != f.dataType:
            raise ValueError(f"column {f.name} was {known[f.name].simpleString()} and is {f.dataType.simpleString()}")
    fields = [*old, *(f for f in new if f.name not in known)]
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in fields])


SKETCHED = "index_name string, column string, sketch binary"
SKETCH_BITS = 14  # an error of 0.8 %, one standard deviation
POSTED = "index_name string, column string, value string, file string, bucket bigint, bits binary"


def add_segment(root: str, rows: DataFrame, sketched: tuple[str, ...] = (), posted: tuple[str, ...] = ()) -> list[Entry]:
    """Store ``rows`` (index_name and more) as a segment, the table of its files, for each index a sketch of the distinct
    values of each ``sketched`` column, and for each value (and null) of a ``posted`` column, which should have few, a bitmap of
    the rows that have it, a row for each file and 32,768 rows. Its entries aren't in any version yet."""
    spark, segment = rows.sparkSession, uuid.uuid4().hex
    name = F.when(F.col("index_name").isNull(), F.raise_error(F.lit("a row has no index_name"))).otherwise(F.col("index_name"))
    folder = f"{root}/data/seg={segment}"
    rows.withColumn("index_name", name.cast("string")).write.partitionBy("index_name").parquet(folder)
    own = spark.read.schema(rows.schema).parquet(folder)
    has = own.columns.__contains__
    key = F.struct((F.col("path") if has("path") else F.lit(None).cast("string")).alias("path"), (F.col("chunk_no") if has("chunk_no") else F.lit(None)).cast("int").alias("chunk_no"))
    stats = [
        F.count("*").alias("rows"),
        (F.sum("storage_bytes") if has("storage_bytes") else F.sum(F.lit(0))).cast("long").alias("storage_bytes"),
        (F.count_if(F.col("chunk_no") == 0) if has("chunk_no") else F.sum(F.lit(0))).cast("long").alias("paths"),
        F.min(key).alias("least"),
        F.max(key).alias("greatest"),
    ]
    created = F.min("created_at") if has("created_at") else F.min(F.lit(None).cast("timestamp"))
    own = own.withColumn("language", F.coalesce("language", F.lit("unknown")) if has("language") else F.lit("unknown"))
    by_file = own.groupBy("index_name", F.col("_metadata.file_name").alias("file"), "language").agg(*stats, created.cast("double").alias("created"), F.min("_metadata.file_path").alias("at"))
    by_file.write.parquet(f"{root}/files/seg={segment}")
    held = spark.read.schema(by_file.schema).parquet(f"{root}/files/seg={segment}")
    if sketched:
        values = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in sketched])).alias("x")
        pairs = spark.read.schema(rows.schema).parquet(folder).select("index_name", values).select("index_name", "x.*").where("value IS NOT NULL")
        pairs.groupBy("index_name", "column").agg(F.hll_sketch_agg("value", F.lit(SKETCH_BITS)).alias("sketch")).write.parquet(f"{root}/sketches/seg={segment}")
    if posted:
        values = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in posted])).alias("x")
        held_rows = spark.read.schema(rows.schema).parquet(folder)
        places = held_rows.select("index_name", F.col("_metadata.file_name").alias("file"), (F.col("_metadata.row_index") + 1).alias("at"), values).select("index_name", "file", "at", "x.*")
        bits = places.groupBy("index_name", "column", "value", "file", F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
        bits.write.option("compression", "zstd").parquet(f"{root}/postings/seg={segment}")
    entries: dict[str, Entry] = {}
    for name, language, n, size, paths, when, at in held.groupBy("index_name", "language").agg(F.sum("rows"), F.sum("storage_bytes"), F.sum("paths"), F.min("created"), F.min("at")).collect():
        own_folder = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(at)).getParent().getName()
        e = entries.setdefault(name, Entry(segment, name, f"seg={segment}/{own_folder}", 0, 0, 0, 0, when, {}))
        e.rows, e.storage_bytes, e.paths, e.languages[language] = e.rows + n, e.storage_bytes + size, e.paths + paths, n
        e.created = min((x for x in (e.created, when) if x is not None), default=None)
    return list(entries.values())


def rows(spark: SparkSession, root: str, version: Version, names: list[str] | None = None, positions: bool = False, files: list[str] | None = None) -> DataFrame:
    """The version's rows (of some indexes, of some files); ``positions``: with segment, file and row of each."""
    place = {"segment": F.col("seg"), "file": F.col("_metadata.file_name"), "row": F.col("_metadata.row_index")}
    columns = [*version.schema.names, *(place if positions else ())]
    live = [e for e in version.entries if e.chunks and (names is None or e.index_name in names)]
    whole, parted = [e for e in live if not e.dropped], [e for e in live if e.dropped]

    def read(entries: list[Entry]) -> DataFrame:
        own = spark.read.schema(T.StructType([*version.schema, T.StructField("seg", T.StringType())])).option("basePath", f"{root}/data").parquet(*[f"{root}/data/{e.folder}" for e in entries])
        return own if files is None else own.where(F.col("_metadata.file_name").isin(files))

    parts = []
    if whole:
        own = read(whole)
        parts.append((own.withColumns(place) if positions else own).select(*columns))
    if parted:
        gone = spark.read.schema(POSITIONS).parquet(*[f"{root}/dropped/{d}" for d in version.dropped])
        few = sum(version.dropped.values()) <= BROADCAST_POSITIONS
        parts.append(read(parted).withColumns(place).join(gone.hint("broadcast" if few else "merge"), ["index_name", "file", "row"], "left_anti").select(*columns))
    if not parts:
        kinds = {"segment": T.StringType(), "file": T.StringType(), "row": T.LongType()}
        return spark.createDataFrame([], T.StructType([*version.schema, *(T.StructField(n, kinds[n]) for n in columns[len(version.schema) :])]))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def drop_rows(root: str, version: Version, doomed: DataFrame) -> Version:
    """``version`` without the rows ``doomed`` (of ``rows`` with positions), whose positions are stored. One pass over them."""
    spark, folder = doomed.sparkSession, f"drop={uuid.uuid4().hex}"
    has = doomed.columns.__contains__
    size = F.col("storage_bytes") if has("storage_bytes") else F.lit(0)
    first = (F.col("chunk_no") == 0) if has("chunk_no") else F.lit(False)
    language = F.coalesce("language", F.lit("unknown")) if has("language") else F.lit("unknown")
    held = doomed.select("index_name", "file", "row", "segment", size.cast("long").alias("size"), first.alias("first"), language.alias("language"))
    held.write.parquet(f"{root}/dropped/{folder}")
    counts = spark.read.schema(held.schema).parquet(f"{root}/dropped/{folder}").groupBy("segment", "index_name", "language").agg(F.count("*"), F.sum("size"), F.count_if("first")).collect()
    entries = {(e.segment, e.index_name): Entry(**vars(e) | {"languages": dict(e.languages)}) for e in version.entries}
    for segment, name, language, n, size, paths in counts:
        e = entries[segment, name]
        e.dropped, e.storage_bytes, e.paths = e.dropped + n, e.storage_bytes - size, e.paths - paths
        e.languages[language] -= n
    more = {folder: sum(c[3] for c in counts)} if counts else {}
    return Version(version.number, version.schema, list(entries.values()), version.dropped | more)


def estimates(spark: SparkSession, root: str, version: Version, by_index: bool = True) -> DataFrame:
    """(index_name, column, estimate) of distinct values, or over all indexes (column, estimate): from the sketches of
    the version's segments, which are merged; no row is read. Rows that were dropped since still count."""
    live = spark.createDataFrame([(e.segment, e.index_name) for e in version.entries if e.chunks], "seg string, index_name string")
    folders = [f for s in sorted({e.segment for e in version.entries if e.chunks}) if exists(spark, f := f"{root}/sketches/seg={s}")]
    keys = ["index_name", "column"] if by_index else ["column"]
    if not folders:
        return spark.createDataFrame([], ", ".join(f"{k} string" for k in keys) + ", estimate bigint")
    held = spark.read.schema(f"{SKETCHED}, seg string").option("basePath", f"{root}/sketches").parquet(*folders)
    own = held.join(F.broadcast(live), ["seg", "index_name"], "left_semi")  # an entry for each segment and index
    return own.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))


def postings(spark: SparkSession, root: str, version: Version, names: list[str] | None = None) -> DataFrame | None:
    """The bitmaps of the version's segments (and of some indexes), or None if a segment has none."""
    live = [e for e in version.entries if e.chunks and (names is None or e.index_name in names)]
    folders = [f"{root}/postings/seg={s}" for s in sorted({e.segment for e in live})]
    if not folders or not all(exists(spark, f) for f in folders):
        return None
    held = spark.read.schema(f"{POSTED}, seg string").option("basePath", f"{root}/postings").parquet(*folders)
    return held.where(F.col("index_name").isin([e.index_name for e in live]))


def vacuum(spark: SparkSession, root: str) -> None:
    """Delete stored segments and versions that the newest version doesn't need; for times when nobody reads older ones."""
    version = current(spark, root)
    used = {f"seg={e.segment}" for e in version.entries if e.chunks}
    dropped = version.dropped if any(e.dropped for e in version.entries) else {}
    for kind, keep in (("data", used), ("files", used), ("sketches", used), ("postings", used), ("dropped", set(dropped)), ("versions", {f"{version.number:012d}.json"})):
        fs, folder = _path(spark, f"{root}/{kind}")
        if fs.exists(folder):
            for f in fs.listStatus(folder):
                if f.getPath().getName() not in keep:
                    fs.delete(f.getPath(), True)
    folders = {e.folder for e in version.entries}
    for segment in used:  # indexes that were replaced or dropped within a segment that others need
        fs, folder = _path(spark, f"{root}/data/{segment}")
        for f in fs.listStatus(folder):
            if f.isDirectory() and f"{segment}/{f.getPath().getName()}" not in folders:
                fs.delete(f.getPath(), True)


def next_page(spark: SparkSession, root: str, version: Version, n: int, after: tuple[str, int] | None = None) -> DataFrame:
    """The ``n`` rows that come next after a key (path, chunk_no) in its order. Only files whose bounds reach into the page are read."""
    segments = sorted({e.segment for e in version.entries if e.chunks})
    if not segments:
        return rows(spark, root, version)
    as_key = lambda k: F.struct(F.lit(k[0]).alias("path"), F.lit(k[1]).alias("chunk_no"))
    files = spark.read.schema(FILES).parquet(*[f"{root}/files/seg={s}" for s in segments])
    files = files if after is None else files.where(F.col("greatest") > as_key(after))
    # every file of the list has a row beyond the start; n of them, and one for each dropped row, reach over the page
    lost = sum(e.dropped for e in version.entries)
    first = files.orderBy("greatest").select("least", "greatest", "rows").limit(n + lost).collect()
    bound, held = None, 0
    for least, greatest, count in first:
        held += count if after is None or tuple(least) > after else 1
        if held >= n + lost:
            bound = greatest
            break
    files = files if bound is None else files.where(F.col("least") <= as_key(bound))
    names = [r[0] for r in files.select("file").distinct().limit(MOST_FILES + 1).collect()]
    table = rows(spark, root, version, files=names if len(names) <= MOST_FILES else None)
    key = F.struct("path", "chunk_no")
    if after is not None:
        table = table.where((F.col("path") >= after[0]) & (key > as_key(after)))
    if bound is not None:
        table = table.where((F.col("path") <= bound[0]) & (key <= as_key(bound)))
    return table.orderBy("path", "chunk_no").limit(n)
