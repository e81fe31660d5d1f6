"""The binary episode container: catalog and block scans, and its sink.

A container is a header of 64 bytes, an index entry of 48 bytes for each block, a
table of names and the blocks' data, each block compressed and checksummed by
itself. Files are listed by Spark's ``binaryFile`` source. A scan then opens each
file where it lies and fetches the header, the index and the blocks that it asks
for, each by its place (``sources.files``); where a store can't be opened that way,
``access="whole"`` fetches whole files by Spark. A scan that names blocks fetches,
decompresses and checks those alone.
"""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.binary import compress, crc32c, decompress, encode_tensor, name_hash
from ..functions.names import FLAG_COMPRESSED, FLAG_LZ4, FLAG_ZSTD
from .files import Memory, opened, write_files

#: Fixed values of the format.
MAGIC, VERSION, HEADER, ENTRY = b"SHRD", 2, 64, 48
ROLE_MANIFEST, ROLE_EPISODE = 4, 5
FLAG_CHECKSUMS, FLAG_CONTENT_TYPES = 0x20, 0x80
_HEAD, _ENTRY = struct.Struct("<4sBBHBBHIQQQQ16x"), struct.Struct("<QIHHQQQII")
CODECS = ("none", "zstd", "lz4")
MOST_BLOCKS, MOST_NAMES = 1_000_000, 64 << 20

BLOCKS = """file string, role int, entry_idx int, name string, lane string, channel string, name_hash decimal(20,0), flags int, codec string,
 content_type int, tag_bits int, data_offset bigint, disk_size bigint, orig_size bigint, crc32c bigint, crc_ok boolean, hash_ok boolean, payload binary, error string"""


def _arrow_schema(ddl: str):
    """The Arrow schema of a DDL string; needs the driver's session."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


class Broken(ValueError):
    """A container that breaks the format."""


def read_header(data) -> dict:
    """The header of a container: bytes, or an opened file."""
    source = Memory.of(data)
    size, data = source.size, source.read(0, HEADER)
    if len(data) < HEADER:
        raise Broken("the header is cut short")
    magic, version, role, flags, alignment, codec, entry, count, names, start, schema, total = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise Broken("no container")
    if version != VERSION:
        raise Broken(f"version {version} is not supported")
    if entry != ENTRY or codec >= len(CODECS) or alignment not in (0, 16, 32, 64):
        raise Broken("the header has values that the format doesn't know")
    if count > MOST_BLOCKS or HEADER + count * ENTRY > size or total not in (0, size):
        raise Broken("the file has another size than its header says")
    if not HEADER + count * ENTRY <= names <= start <= size or start - names > MOST_NAMES or schema > size:
        raise Broken("sections overlap or lie outside the file")
    return {"role": role, "flags": flags, "alignment": alignment, "codec": CODECS[codec], "count": count, "names": names, "data": start, "schema": schema}


def read_entries(data) -> tuple[dict, list[dict]]:
    """Header and index of bytes or an opened file; the blocks' data aren't touched."""
    source = Memory.of(data)
    head = read_header(source)
    index = source.read(HEADER, head["count"] * ENTRY)
    names = source.read(head["names"], head["data"] - head["names"])
    out, spans = [], []
    for i in range(head["count"]):
        hashed, at, size, flags, offset, disk, orig, crc, reserved = _ENTRY.unpack_from(index, i * ENTRY)
        if at + size > len(names):
            raise Broken(f"the name of block {i} lies outside the table")
        if disk and (offset < head["data"] or offset + disk > source.size):
            raise Broken(f"block {i} lies outside the file")
        try:
            name = names[at : at + size].decode()
        except UnicodeDecodeError:
            raise Broken(f"the name of block {i} is no UTF-8") from None
        codec = "none" if not flags & FLAG_COMPRESSED else "lz4" if flags & FLAG_LZ4 else "zstd" if flags & FLAG_ZSTD else head["codec"]
        if codec == "none" and disk != orig:
            raise Broken(f"block {i} isn't compressed but has two sizes")
        out.append({"name": name, "hash": hashed, "flags": flags, "codec": codec, "offset": offset, "disk": disk, "orig": orig, "crc": crc, "reserved": reserved})
        if disk:
            spans.append((offset, offset + disk))
    spans.sort()
    if any(a[1] > b[0] for a, b in zip(spans, spans[1:], strict=False)):
        raise Broken("blocks overlap")
    return head, out


def read_block(data, entry: dict, has_checksums: bool = True, verify: bool = True) -> tuple[bytes, bool]:
    """A block's bytes and whether their checksum is right; one that isn't stored is."""
    try:
        payload = decompress(Memory.of(data).read(entry["offset"], entry["disk"]), entry["codec"], entry["orig"])
    except ValueError as e:
        raise Broken(str(e)) from None
    stored = entry["crc"] or has_checksums
    return payload, not verify or not stored or crc32c(payload) == entry["crc"]


def read_prefix(data, entry: dict, n: int) -> bytes:
    """The first ``n`` bytes of a block, unchecked.

    Of a block that isn't compressed no more is fetched; of a zstd block so much
    as they need; an LZ4 block is decompressed whole.
    """
    source, at, disk = Memory.of(data), entry["offset"], entry["disk"]
    if entry["codec"] == "none":
        return source.read(at, min(n, disk))
    if entry["codec"] == "lz4" or n >= entry["orig"]:
        return read_block(source, entry, verify=False)[0][:n]
    import zstandard

    out, done, step = b"", 0, 4_096
    unpack = zstandard.ZstdDecompressor().decompressobj()
    try:
        while len(out) < n and done < disk and not unpack.eof:
            out += unpack.decompress(source.read(at + done, min(step, disk - done)))
            done, step = done + step, step * 2
    except zstandard.ZstdError as e:
        raise Broken(f"a zstd block is broken: {e}") from None
    if len(out) < n:
        raise Broken("a block has another size than stated")
    return out[:n]


def write_container(blocks: dict[str, bytes], codec: str = "zstd", alignment: int = 32, role: int = ROLE_EPISODE, content_types: dict[str, int] | None = None) -> bytes:
    """The bytes of a container; blocks lie in the order of their names.

    A block is compressed if it has 64 bytes or more and gets smaller.
    """
    names = sorted(blocks)
    table = "".join(names).encode()
    start = HEADER + len(names) * ENTRY + len(table)
    entries, parts, at, where = [], [], start, 0
    for name in names:
        raw = blocks[name]
        packed = compress(raw, codec) if len(raw) >= 64 else raw
        flags = 0
        if len(packed) < len(raw):
            flags = FLAG_COMPRESSED | (FLAG_LZ4 if codec == "lz4" else FLAG_ZSTD)
        else:
            packed = raw
        gap = -at % alignment if alignment else 0
        parts.append(b"\0" * gap + packed)
        at += gap
        size = len(name.encode())
        entries.append(_ENTRY.pack(name_hash(name), where, size, flags, at, len(packed), len(raw), crc32c(raw), (content_types or {}).get(name, 0)))
        at, where = at + len(packed), where + size
    flags = FLAG_CHECKSUMS | (FLAG_CONTENT_TYPES if content_types else 0)
    head = _HEAD.pack(MAGIC, VERSION, role, flags, alignment, CODECS.index(codec), ENTRY, len(names), HEADER + len(names) * ENTRY, start, 0, at)
    return b"".join([head, *entries, table, *parts])


def parse_blocks(files: DataFrame, prefix: str | None = None, names: list[str] | None = None, payload: bool = True, verify: bool = True, first_bytes: int | None = None, permissive: bool = False) -> DataFrame:
    """The blocks of containers (path, content or length), a row each.

    Without content the files are opened and read by place. ``prefix`` and
    ``names`` choose blocks before their data are touched. ``first_bytes`` asks for
    the beginning of payloads, which can't be checked. A broken container fails the
    scan, or with ``permissive`` gives one row with its error.
    """
    if first_bytes is not None and first_bytes < 0:
        raise ValueError("first_bytes is negative")
    wanted = None if names is None else set(names)

    def rows(path: str, data):
        head, entries = read_entries(data)
        for i, e in enumerate(entries):
            name = e["name"]
            if (wanted is not None and name not in wanted) or (prefix and name != prefix and not name.startswith(f"{prefix}/")):
                continue
            if payload and first_bytes is not None:
                block, ok = read_prefix(data, e, first_bytes), None
            else:
                block, ok = read_block(data, e, bool(head["flags"] & FLAG_CHECKSUMS), verify) if payload or verify else (None, None)
            lane, _, channel = name.partition("/")
            yield (path, head["role"], i, name, lane, channel, e["hash"], e["flags"], e["codec"], e["reserved"] & 0xFFFF, e["reserved"] >> 16, e["offset"], e["disk"], e["orig"], e["crc"], ok, e["hash"] == name_hash(name), block if payload else None, None)

    schema = _arrow_schema(BLOCKS)
    whole = "content" in files.columns

    def run(batches):
        from decimal import Decimal

        import pyarrow as pa

        for batch in batches:
            for path, held in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    if whole:
                        out = list(rows(path, held.as_py()))
                    else:
                        with opened(path, held.as_py()) as source:
                            out = list(rows(path, source))
                except Broken as e:
                    if not permissive:
                        raise Broken(f"{path}: {e}") from None
                    out = [(path, *[None] * 17, str(e))]
                if out:
                    columns = [list(c) for c in zip(*out, strict=True)]
                    columns[6] = [None if h is None else Decimal(h) for h in columns[6]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], names=schema.names)

    return files.select("path", "content" if whole else "length").mapInArrow(run, BLOCKS)


def read_blocks(spark: SparkSession, path: str, access: str = "seek", **options) -> DataFrame:
    """The blocks of the container files of a path or glob; see ``parse_blocks``.

    With ``access="whole"`` Spark fetches whole files, from any store that it reads.
    """
    if access not in ("seek", "whole"):
        raise ValueError("access is seek or whole")
    files = spark.read.format("binaryFile").load(path)
    return parse_blocks(files.select("path", "content" if access == "whole" else "length"), **options)


def catalog(spark: SparkSession, path: str, **options) -> DataFrame:
    """Header and index of container files, without blocks' data."""
    return read_blocks(spark, path, payload=False, verify=False, **options).drop("payload", "crc_ok")


def verify_blocks(blocks: DataFrame) -> DataFrame:
    """Of each file: blocks checked, wrong checksums, and wrong name hashes."""
    return blocks.groupBy("file").agg(F.count("*").alias("checked"), F.count_if(~F.col("crc_ok")).alias("failures"), F.count_if(~F.col("hash_ok")).alias("hash_failures"))


def pack_episodes(steps: DataFrame, columns: dict[str, tuple[str, str]], by: str = "episode_id", order: str = "t", codec: str = "zstd", tick_hz: float = 30.0) -> DataFrame:
    """(path, content): a container for each episode.

    ``columns`` maps block names to (column, dtype); array columns keep their
    width. Every lane named is written. A task holds one episode.
    """
    import json

    arrays = F.sort_array(F.collect_list(F.struct(order, *{c for c, _ in columns.values()})))
    grouped = steps.groupBy(by).agg(arrays.alias("_s"))
    picked = grouped.select(F.col(by).cast("string").alias("id"), F.size("_s").alias("n"), *[_flat(steps, c).alias(f"_{i}") for i, (c, _) in enumerate(columns.values())], *[_width(steps, c).alias(f"_w{i}") for i, (c, _) in enumerate(columns.values())])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = [[], []]
            for r in batch.to_pylist():
                blocks, channels = {}, []
                for i, (name, (_, dtype)) in enumerate(columns.items()):
                    blocks[name] = encode_tensor(r[f"_{i}"], dtype)
                    if "/" in name:
                        channels.append({"id": name.split("/", 1)[1], "dtype": dtype, "shape": [r[f"_w{i}"]], "signal_block": name})
                blocks["meta/episode"] = json.dumps({"episode_id": r["id"], "length_T": r["n"], "timebase": {"type": "ticks", "tick_hz": tick_hz}}).encode()
                blocks["meta/channels"] = json.dumps({"channels": channels}).encode()
                blocks["time/ticks"] = encode_tensor(range(r["n"]), "i32")
                out[0].append(f"{r['id']}.bin")
                out[1].append(write_container(blocks, codec))
            yield pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1], pa.binary())], names=["path", "content"])

    return picked.mapInArrow(run, "path string, content binary")


def _flat(steps: DataFrame, column: str):
    values = F.transform("_s", lambda s: s[column])
    return F.flatten(values) if dict(steps.dtypes)[column].startswith("array") else values


def _width(steps: DataFrame, column: str):
    return F.coalesce(F.size(F.get("_s", F.lit(0))[column]), F.lit(0)) if dict(steps.dtypes)[column].startswith("array") else F.lit(1)


def decode_steps(blocks: DataFrame) -> DataFrame:
    """The steps of episodes from their blocks: (file, lane, channel, t, value).

    The blocks' dtypes and widths are joined in from meta/channels; reward and
    done are f32 and u8 unless stated, and blocks without a channel are flat f32.
    """
    meta = blocks.where("name = 'meta/channels'").select("file", F.from_json(F.col("payload").cast("string"), "channels array<struct<id:string,dtype:string,shape:array<int>,signal_block:string>>").alias("m"))
    listed = meta.select("file", F.explode("m.channels").alias("c")).select("file", F.coalesce("c.signal_block", F.concat(F.lit("signal/"), "c.id")).alias("name"), "c.dtype", F.aggregate("c.shape", F.lit(1), lambda a, x: a * x).alias("width"))
    data = blocks.where("lane not in ('meta', 'time')").join(listed, ["file", "name"], "left")
    dtype = F.coalesce("dtype", F.when(F.col("name") == "done", "u8").otherwise("f32"))

    @F.pandas_udf("array<double>")
    def decode(payload, kinds):
        from ..functions.binary import decode_tensor

        return payload.combine(kinds, lambda p, k: decode_tensor(bytes(p), k).astype("f8"))

    flat = data.select("file", "lane", "channel", "name", F.coalesce("width", F.lit(1)).alias("width"), decode("payload", dtype).alias("flat"))
    rows = F.transform(F.sequence(F.lit(0), (F.size("flat") / F.col("width")).cast("int") - 1), lambda i: F.slice("flat", i * F.col("width") + 1, F.col("width")))
    return flat.where(F.size("flat") >= F.col("width")).select("file", "name", "lane", "channel", F.posexplode(rows).alias("t", "value")).withColumn("t", F.col("t").cast("bigint"))


def file_metadata(files: DataFrame) -> DataFrame:
    """(file, metadata): the JSON behind a container's schema offset, null where it has none."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for content in batch.column("content"):
                data = content.as_py()
                at = read_header(data)["schema"]
                out.append(data[at:].decode("utf-8", "replace") if at else None)
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(out, pa.string())], names=["file", "metadata"])

    return files.select("path", "content").mapInArrow(run, "file string, metadata string")


def with_metadata(container: bytes, metadata: bytes) -> bytes:
    """A container with JSON metadata at its end."""
    head = list(_HEAD.unpack_from(container))
    head[3] |= 0x10
    head[10], head[11] = len(container), len(container) + len(metadata)
    return _HEAD.pack(*head) + container[HEADER:] + metadata


def inspect(blocks: DataFrame) -> DataFrame:
    """Of each file: its blocks, how many are compressed, sizes and their ratio."""
    compressed = F.count_if(F.col("codec") != "none")
    return blocks.groupBy("file").agg(F.count("*").alias("n_blocks"), compressed.alias("n_compressed"), F.sum("orig_size").alias("orig_size"), F.sum("disk_size").alias("disk_size"), (F.sum("orig_size") / F.sum("disk_size")).alias("ratio"))
