"""Bundle sink and source.

A bundle is an ordered sequence of typed JSON records, one per line, in one
gzip file.  In Spark it is one flat DataFrame with a section sort key
(``section, k1, k2, k3``) plus every record field.  A record may be made of
several rows (``part`` 0 the record up to its list, 1 an item of the list, 2
its end), so that no row holds a list that grows with the data.

The sink sorts the rows into ranges; each task writes its range as one gzip
member and reports it.  The members' bytes are then put together in order,
and a manifest (member, offset, bytes, records, checksum) is written last: it
commits the bundle and is the index by which tasks read members in parallel
and in order.  A bundle without its manifest, or whose bytes are not those of
the manifest, is refused.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsspark.operators.checks import DataCheckError
from obsspark.session import keep
from obsspark.sources.ranges import READ_BYTES, default_store, locate, run_on_batches

SORT_COLUMNS = [("section", "int"), ("k1", "bigint"), ("k2", "string"), ("k3", "bigint")]

RECORD_COLUMNS = [
    ("type", "string"), ("bundle_id", "string"), ("created_at", "string"), ("params", "string"),
    ("service", "string"), ("file", "string"), ("journal", "string"), ("journal_scope", "string"),
    ("journal_user", "string"), ("namespace", "string"), ("pod", "string"), ("container", "string"),
    ("ts", "string"), ("previous", "boolean"), ("line", "string"), ("skipped", "boolean"),
    ("reason", "string"), ("error", "string"), ("message", "string"), ("involved_kind", "string"),
    ("involved_name", "string"), ("involved_namespace", "string"), ("pod_ip", "string"),
    ("port", "bigint"), ("path", "string"), ("url", "string"), ("ok", "boolean"), ("content", "string"),
    ("max_total_log_lines", "bigint"), ("line_limited", "boolean"), ("matched_log_records", "bigint"),
    ("returned_log_records", "bigint"), ("diagnostic_records", "bigint"),
    ("raw_log_records", "bigint"), ("part", "int"),
]

FLAT_COLUMNS = SORT_COLUMNS + RECORD_COLUMNS


def conform(df: DataFrame) -> DataFrame:
    """Select the flat bundle columns, typed; absent ones become NULL."""
    return df.select(*[(F.col(n).cast(t) if n in df.columns else F.lit(None).cast(t)).alias(n) for n, t in FLAT_COLUMNS])


def order_key(*parts: Column) -> Column:
    """A string whose byte order equals the tuple order of ``parts``.

    Text parts are joined with U+0000 (below every character used in
    names); integers must be non-negative and are zero-padded.
    """
    return F.concat_ws("\u0000", *parts)


def int_key(c: Column, width: int = 19) -> Column:
    return F.lpad(c.cast("string"), width, "0")


def _journal_fields(scope: Column, user: Column):
    is_user = F.coalesce(scope == F.lit("user"), F.lit(False))
    return F.when(is_user, F.lit("user")), F.when(is_user, user)


def record_json(df: DataFrame) -> tuple[Column, Column]:
    """The JSON text of each flat bundle row, in the reference's shape."""
    c = F.col
    scope, user = _journal_fields(c("journal_scope"), c("journal_user"))
    involved = F.when(c("involved_kind").isNotNull() | c("involved_name").isNotNull(), F.struct(
        c("involved_kind").alias("kind"), c("involved_name").alias("name"),
        c("involved_namespace").alias("namespace")))
    body = F.to_json(F.struct(
        # an item of a list has no type of its own
        F.when(F.coalesce(c("part"), F.lit(0)) == 0, c("type")).alias("type"), c("bundle_id").alias("bundleId"), c("created_at").alias("createdAt"),
        c("namespace").alias("namespace"), c("pod").alias("pod"), c("container").alias("container"),
        c("service").alias("service"), c("file").alias("file"), c("journal").alias("journal"),
        scope.alias("journalScope"), user.alias("journalUser"),
        c("pod_ip").alias("podIP"), c("port").alias("port"), c("path").alias("path"), c("url").alias("url"),
        c("ts").alias("ts"), c("previous").alias("previous"), c("skipped").alias("skipped"),
        c("reason").alias("reason"), c("error").alias("error"), c("line").alias("line"),
        c("message").alias("message"), involved.alias("involvedObject"),
        c("ok").alias("ok"), c("content").alias("content"),
        c("max_total_log_lines").alias("maxTotalLogLines"), c("line_limited").alias("lineLimited"),
        c("raw_log_records").alias("rawLogRecords"),
        c("matched_log_records").alias("matchedLogRecords"), c("returned_log_records").alias("returnedLogRecords"),
        c("diagnostic_records").alias("diagnosticRecords")))
    opened = F.expr("substring(_body, 1, length(_body) - 1)")
    # meta carries the request as a JSON object, spliced in verbatim.
    with_params = F.concat(opened, F.lit(',"params":'), c("params"), F.lit("}"))
    text = (F.when(c("params").isNotNull(), with_params)
            .when(c("part") == 0, F.concat(opened, F.lit(',"sources":[')))
            # k3 tells the first item from the others
            .when(c("part") == 1, F.concat(F.when(c("k3") == 0, F.lit("")).otherwise(F.lit(",")), F.col("_body")))
            .when(c("part") == 2, F.lit("]}")).otherwise(F.col("_body")))
    return text, body


def bundle_text(flat: DataFrame) -> DataFrame:
    """(section, k1, k2, k3, value, begins, ends): ``value`` is a JSON line, or a piece of one.

    ``begins`` and ``ends`` tell whether a record begins with the piece, or ends with it."""
    text, body = record_json(flat)
    part = F.col("part")
    return flat.withColumn("_body", body).select(
        *[n for n, _ in SORT_COLUMNS], text.alias("value"), F.coalesce(part == 0, F.lit(True)).alias("begins"),
        F.coalesce(part == 2, F.lit(True)).alias("ends"))


ARTEFACT, MANIFEST, MEMBERS = "bundle.ndjson.gz", "manifest", "members"
_MEMBER = "member int, name string, bytes long, records long, begins boolean, sha256 string"
_GZIP = 31


def _write_members(folder: str, store: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = locate(folder, store)
        # a task that is run again writes another file; the one whose report counts is in the manifest
        member, name = TaskContext.get().partitionId(), f"{uuid.uuid4().hex}.gz"
        out, gz, digest, size, records, begins = None, zlib.compressobj(wbits=_GZIP), sha256(), 0, 0, None

        def put(data: bytes) -> None:
            nonlocal size
            out.write(data)
            digest.update(data)
            size += len(data)

        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                system.create_dir(inner, recursive=True)
                out = system.open_output_stream(f"{inner}/{name}", compression=None)
            texts, starts, ends = (batch.column(c).to_pylist() for c in ("value", "begins", "ends"))
            begins = starts[0] if begins is None else begins
            records += sum(starts)
            put(gz.compress("".join(t + "\n" if e else t for t, e in zip(texts, ends, strict=True)).encode()))
        if out is not None:
            put(gz.flush())
            out.close()
            yield pa.RecordBatch.from_pylist([{"member": member, "name": name, "bytes": size, "records": records, "begins": begins,
                                               "sha256": digest.hexdigest()}],
                                             pa.schema([("member", pa.int32()), ("name", pa.string()), ("bytes", pa.int64()), ("records", pa.int64()),
                                                        ("begins", pa.bool_()), ("sha256", pa.string())]))
    return run


def _join_members(folder: str, store: str):
    """Copies the members, in order, into one file of a passing name, whose name and size are the result."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = locate(folder, store)
        name, size = f"{MEMBERS}/{uuid.uuid4().hex}.whole", 0
        with system.open_output_stream(f"{inner}/{name}", compression=None) as out:
            for batch in batches:
                for member in batch.column("name").to_pylist():
                    with system.open_input_file(f"{inner}/{MEMBERS}/{member}") as file:
                        while data := file.read(READ_BYTES):
                            out.write(data)
                            size += len(data)
        yield pa.RecordBatch.from_pylist([{"name": name, "bytes": size}], pa.schema([("name", pa.string()), ("bytes", pa.int64())]))
    return run


def _path(spark: SparkSession, *names: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join(names))
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_bundle(flat: DataFrame, path: str) -> None:
    """One gzip NDJSON file in bundle order (``bundle.ndjson.gz``) and its manifest.

    The global sort range-partitions rows by the section key; every task
    compresses its range as a gzip member.  The file is a copy of the members'
    compressed bytes, streamed by one task, since a file has one writer.  The
    manifest is the commit: it is written when everything else is in place.
    """
    spark = flat.sparkSession
    top, store_fs = _path(spark, path)
    if store_fs.exists(top):
        raise DataCheckError(f"'{path}' exists already")
    store = default_store(spark)
    ordered = bundle_text(flat).orderBy(F.col("section").asc(), F.col("k1").asc_nulls_first(), F.col("k2").asc_nulls_first(),
                                        F.col("k3").asc_nulls_first()).select("value", "begins", "ends")
    members = keep(run_on_batches(ordered, _write_members(f"{path}/{MEMBERS}", store), _MEMBER))
    in_order = members.coalesce(1).sortWithinPartitions("member")
    whole = keep(run_on_batches(in_order.select("name"), _join_members(path, store), "name string, bytes long")).first()
    if whole is None:
        raise DataCheckError("a bundle has at least one record")
    if not store_fs.rename(_path(spark, path, whole["name"])[0], _path(spark, path, ARTEFACT)[0]):
        raise DataCheckError(f"'{path}/{ARTEFACT}' could not be put in place")
    # a row per member
    before = Window.orderBy("member").rowsBetween(Window.unboundedPreceding, -1)
    manifest = members.drop("name").withColumns({c: F.coalesce(F.sum(v).over(before), F.lit(0)).cast("long") for c, v in (("offset", "bytes"), ("first_record", "records"))})
    manifest.coalesce(1).sortWithinPartitions("member").write.json(f"{path}/{MANIFEST}")
    store_fs.delete(_path(spark, path, MEMBERS)[0], True)


BUNDLE_JSON_SCHEMA = T.StructType([
    T.StructField("type", T.StringType()), T.StructField("bundleId", T.StringType()),
    T.StructField("createdAt", T.StringType()), T.StructField("params", T.StringType()),
    T.StructField("namespace", T.StringType()), T.StructField("pod", T.StringType()),
    T.StructField("container", T.StringType()), T.StructField("service", T.StringType()),
    T.StructField("file", T.StringType()), T.StructField("journal", T.StringType()),
    T.StructField("journalScope", T.StringType()), T.StructField("journalUser", T.StringType()),
    T.StructField("podIP", T.StringType()), T.StructField("port", T.LongType()),
    T.StructField("path", T.StringType()), T.StructField("url", T.StringType()),
    T.StructField("ts", T.StringType()), T.StructField("previous", T.BooleanType()),
    T.StructField("skipped", T.BooleanType()), T.StructField("reason", T.StringType()),
    T.StructField("error", T.StringType()), T.StructField("line", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("involvedObject", T.StructType([
        T.StructField("kind", T.StringType()), T.StructField("name", T.StringType()),
        T.StructField("namespace", T.StringType())])),
    T.StructField("ok", T.BooleanType()), T.StructField("content", T.StringType()),
    T.StructField("maxTotalLogLines", T.LongType()), T.StructField("lineLimited", T.BooleanType()),
    T.StructField("matchedLogRecords", T.LongType()), T.StructField("returnedLogRecords", T.LongType()),
    T.StructField("diagnosticRecords", T.LongType()),
    T.StructField("sources", T.ArrayType(T.StructType([
        T.StructField("service", T.StringType()), T.StructField("file", T.StringType()),
        T.StructField("journal", T.StringType()), T.StructField("journalScope", T.StringType()),
        T.StructField("journalUser", T.StringType()), T.StructField("rawLogRecords", T.LongType()),
        T.StructField("matchedLogRecords", T.LongType()), T.StructField("returnedLogRecords", T.LongType()),
        T.StructField("skipped", T.BooleanType()), T.StructField("reason", T.StringType()),
        T.StructField("error", T.StringType())]))),
])


_MANIFEST = "member int, offset long, bytes long, records long, first_record long, begins boolean, sha256 string"


def _plain(file, digest, bytes_left: int) -> Iterator[tuple[bytes, bool]]:
    """(text, own): what the gzip members from here on hold; ``own`` while the first ``bytes_left`` bytes are read, which ``digest`` takes in."""
    gz = zlib.decompressobj(_GZIP)
    own = True
    while True:
        data = file.read(min(READ_BYTES, bytes_left) if own else READ_BYTES)
        if own:
            digest.update(data)
            bytes_left -= len(data)
        if not data:
            return
        while data:
            try:
                text = gz.decompress(data)
            except zlib.error as e:
                raise ValueError("the bundle's bytes are not what its manifest says: no gzip member") from e
            yield text, own
            data = gz.unused_data
            if gz.eof:
                gz = zlib.decompressobj(_GZIP)
        if own and bytes_left == 0:
            own = False


def member_records(file, row: dict) -> Iterator[str]:
    """The records that begin in a member, the last one read on into the next members; raises where the bytes are not the manifest's."""
    file.seek(row["offset"])
    digest, parts, inside, at_start, found = sha256(), [], False, row["begins"], 0
    for text, own in _plain(file, digest, row["bytes"]):
        pos = 0
        while pos < len(text):
            if not inside:
                if not own:
                    break
                if at_start:
                    inside, found = True, found + 1
            newline = text.find(b"\n", pos)
            end = len(text) if newline < 0 else newline
            if inside:
                parts.append(text[pos:end])
            pos = end + 1
            if newline < 0:
                break
            if inside:
                yield b"".join(parts).decode()
                parts = []
            inside, at_start = False, True
        if not own and not inside:
            break
    if inside or found != row["records"] or digest.hexdigest() != row["sha256"]:
        raise ValueError(f"member {row['member']} of the bundle is not what its manifest says")


def _read_members(artefact: str, store: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = locate(artefact, store)
        for batch in batches:
            for row in batch.to_pylist():
                with system.open_input_file(inner) as file:
                    rows, size, number = [], 0, row["first_record"]
                    for value in member_records(file, row):
                        rows.append((row["member"], number, value))
                        number, size = number + 1, size + len(value)
                        if size >= READ_BYTES:
                            yield _records(rows)
                            rows, size = [], 0
                    if rows:
                        yield _records(rows)
    return run


def _records(rows: list[tuple]) -> pa.RecordBatch:
    member, number, value = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(member, pa.int32()), pa.array(number, pa.int64()), pa.array(value, pa.string())], ["member", "record_no", "value"])


def read_bundle(spark: SparkSession, path: str) -> DataFrame:
    """Parse a bundle back into flat record columns.

    ``record_no`` is the record's place in the bundle, from 0.  Tasks read the
    members by the manifest's offsets; ``params`` of the meta record comes back
    as JSON text, ``sources`` of the log summary as an array.  Raises
    ``DataCheckError`` where the manifest is missing or the file is not as long
    as it says; a member with other bytes than the manifest's fails its task.
    """
    (listed, store_fs), (artefact, _) = _path(spark, path, MANIFEST), _path(spark, path, ARTEFACT)
    if not store_fs.exists(_path(spark, path, MANIFEST, "_SUCCESS")[0]) or not store_fs.exists(artefact):
        raise DataCheckError(f"'{path}' is no complete bundle: it has no manifest or no file")
    manifest = spark.read.schema(_MANIFEST).json(listed.toString())
    told = manifest.agg(F.sum("bytes").alias("bytes"), F.max(F.col("offset") + F.col("bytes")).alias("end")).first()
    size = store_fs.getFileStatus(artefact).getLen()
    if not told["bytes"] == told["end"] == size:
        raise DataCheckError(f"'{path}' is torn: its file has {size} bytes, its manifest {told['bytes']}")
    read = run_on_batches(manifest.repartition(F.col("member")), _read_members(f"{path}/{ARTEFACT}", default_store(spark)), "member int, record_no long, value string")
    raw = read.select("member", "record_no", F.from_json("value", BUNDLE_JSON_SCHEMA).alias("r")).select("member", "record_no", "r.*")
    c = F.col
    return raw.select(
        "member", "record_no",
        c("type"), c("bundleId").alias("bundle_id"), c("createdAt").alias("created_at"), c("params"),
        c("service"), c("file"), c("journal"), c("journalScope").alias("journal_scope"),
        c("journalUser").alias("journal_user"), c("namespace"), c("pod"), c("container"), c("ts"),
        c("previous"), c("line"), c("skipped"), c("reason"), c("error"), c("message"),
        c("involvedObject.kind").alias("involved_kind"), c("involvedObject.name").alias("involved_name"),
        c("involvedObject.namespace").alias("involved_namespace"), c("podIP").alias("pod_ip"), c("port"),
        c("path"), c("url"), c("ok"), c("content"), c("maxTotalLogLines").alias("max_total_log_lines"),
        c("lineLimited").alias("line_limited"), c("matchedLogRecords").alias("matched_log_records"),
        c("returnedLogRecords").alias("returned_log_records"), c("diagnosticRecords").alias("diagnostic_records"),
        F.transform(c("sources"), lambda x: F.struct(
            x["service"].alias("service"), x["file"].alias("file"), x["journal"].alias("journal"),
            x["journalScope"].alias("journal_scope"), x["journalUser"].alias("journal_user"),
            x["rawLogRecords"].alias("raw_log_records"), x["matchedLogRecords"].alias("matched_log_records"),
            x["returnedLogRecords"].alias("returned_log_records"), x["skipped"].alias("skipped"),
            x["reason"].alias("reason"), x["error"].alias("error"))).alias("sources"))
