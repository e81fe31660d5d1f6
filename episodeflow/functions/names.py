"""Column functions over block names, paths, globs, dtypes and flags."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of an element of each wire dtype.
DTYPE_SIZES = {"f64": 8, "f32": 4, "f16": 2, "bf16": 2, "i64": 8, "i32": 4, "i16": 2, "i8": 1, "u64": 8, "u32": 4, "u16": 2, "u8": 1, "bool": 1}
#: Bits of an element of the packed quantised dtypes.
PACKED_BITS = {"qint4": 4, "qint3": 3, "qint2": 2, "ternary": 2, "binary": 1}
#: Long names that mean the same dtype.
DTYPE_ALIASES = {"float64": "f64", "double": "f64", "float32": "f32", "float": "f32", "float16": "f16", "half": "f16", "bfloat16": "bf16", "int64": "i64", "int32": "i32", "int16": "i16", "int8": "i8", "uint64": "u64", "uint32": "u32", "uint16": "u16", "uint8": "u8", "boolean": "bool"}
#: Flags of a block's index entry.
FLAG_COMPRESSED, FLAG_ZSTD, FLAG_LZ4, FLAG_CHUNKED = 1, 2, 4, 8
#: What names of embeddings and of output heads hold.
EMBEDDING_MARKS, HEAD_MARKS = ("embed", "tok_embed", "wte", "wpe"), ("norm_final", "ln_f", "lm_head", "output")
MODALITIES = ("rgb", "depth", "language", "proprioception", "audio", "video", "pointcloud")
LANES = ("meta", "signal", "action", "time", "omen", "uncert", "residual", "reward", "done", "aux", "debug")


def split_path(path: Column) -> Column:
    """The parts of a path, without empty ones; of an empty path none."""
    return F.filter(F.split(path, "/"), lambda x: x != "")


def path_parent(path: Column) -> Column:
    """All but the last part; empty where there is one part only."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise("")


def path_base(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def join_path(*parts: Column) -> Column:
    """The parts that aren't empty, joined by slashes."""
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), "/")


def under_prefix(name: Column, prefix: str) -> Column:
    """Whether a name is the prefix or lies below it; all do below an empty one."""
    return F.lit(True) if not prefix else (name == prefix) | name.startswith(f"{prefix}/")


def lane_of(name: Column) -> Column:
    return F.substring_index(name, "/", 1)


def channel_of(name: Column) -> Column:
    """What follows the lane."""
    return F.when(F.contains(name, F.lit("/")), F.regexp_extract(name, r"^[^/]*/(.*)$", 1)).otherwise("")


def block_name(lane: str, channel: Column, *rest: Column) -> Column:
    """lane/channel/..., where a channel that has the lane already keeps it once."""
    head = F.when(channel.startswith(f"{lane}/"), channel).otherwise(F.concat(F.lit(f"{lane}/"), channel))
    return F.concat_ws("/", head, *rest)


def keep_channels(name: Column, allowed: list[str]) -> Column:
    """Channel projection: which blocks a load of some channels reads.

    Metadata, time, reward and done stay; signals, actions, predictions and
    uncertainties stay if all that follows their lane is allowed, residuals if
    their first part after the lane is; blocks of other lanes stay.
    """
    lane, rest = lane_of(name), channel_of(name)
    within = lambda c: c.isin(allowed) if allowed else F.lit(False)
    return F.when(lane.isin("meta", "time") | name.isin("reward", "done"), True).when(lane.isin("signal", "action", "omen", "uncert"), within(rest)).when(lane == "residual", within(F.substring_index(rest, "/", 1))).otherwise(True)


def glob_regex(pattern: str) -> str:
    """The regular expression of a tensor-name glob, for full matches.

    ``**`` between two parts stands for anything between a prefix and a suffix.
    In a path with slashes ``*`` stays within a part and ``?`` is one character;
    in a dotted name ``*`` is one or more characters without a dot.
    """
    if pattern.count("**") == 1:
        head, tail = (re.escape(p.strip(".")) for p in pattern.split("**"))
        return f"{head}.*{tail}"
    inner = "[^/]*" if "/" in pattern else r"[^.]+"
    out = "".join(inner if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in pattern)
    return out


def matches_glob(name: Column, pattern: str) -> Column:
    return name.rlike(f"^(?:{glob_regex(pattern)})$")


def layer_number(name: Column) -> Column:
    """The layer that a tensor name tells, by the first mark that it has; else null."""
    marks = ("layer_", "layers.", "h.", "block.", "blocks.")
    found = [F.regexp_extract(name, re.escape(m).replace("\\_", "_") + r"(\d+)", 1) for m in marks]
    return F.coalesce(*[F.when(x != "", x) for x in found]).cast("int")


def region_of(name: Column) -> Column:
    """0 for embeddings and unknown names, layer + 1, 65535 for output heads."""
    has = lambda *marks: name.rlike("|".join(marks))
    head = has(*HEAD_MARKS)
    return F.when(has(*EMBEDDING_MARKS), 0).when(layer_number(name).isNotNull(), layer_number(name) + 1).when(head, 65535).otherwise(0)


def _lookup(value: Column, table: dict) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.element_at(F.create_map(*pairs), value)


def dtype_name(dtype: Column) -> Column:
    """The canonical short name; null for an unknown dtype."""
    low = F.lower(F.trim(dtype))
    return F.coalesce(_lookup(low, DTYPE_ALIASES), F.when(low.isin(*DTYPE_SIZES, *PACKED_BITS), low))


def dtype_bits(dtype: Column) -> Column:
    return _lookup(dtype_name(dtype), {k: v * 8 for k, v in DTYPE_SIZES.items()} | PACKED_BITS)


def codec_of(flags: Column, default: Column) -> Column:
    """The codec of a block: by its flags, else that of the container."""
    bit = lambda b: flags.bitwiseAND(F.lit(b)) != 0
    named = F.element_at(F.array(F.lit("none"), F.lit("zstd"), F.lit("lz4")), default.cast("int") + 1)
    return F.when(~bit(FLAG_COMPRESSED), "none").when(bit(FLAG_LZ4), "lz4").when(bit(FLAG_ZSTD), "zstd").otherwise(named)


def worth_compressing(size: Column, compressed: Column, least: int = 64, ratio: float = 1.0) -> Column:
    """Whether the compressed form is kept: the block is large enough and gets smaller."""
    return (size >= least) & (compressed < size * F.lit(ratio))


def content_type(reserved: Column) -> Column:
    return reserved.bitwiseAND(F.lit(0xFFFF))


def tag_bits(reserved: Column) -> Column:
    return F.shiftrightunsigned(reserved, 16).bitwiseAND(F.lit(0xFFFF))


def has_tag_bit(reserved: Column, bit: int) -> Column:
    """Whether one of the bits 0 to 15 is set; false for other numbers."""
    return tag_bits(reserved).bitwiseAND(F.lit(1 << bit)) != 0 if 0 <= bit <= 15 else F.lit(False)


def chunk_name(episode: Column, index: Column, suffix: str = "bin") -> Column:
    return F.format_string(f"%s_chunk_%04d.{suffix}", episode.cast("string"), index.cast("int"))


def tick_to_ns(hz: Column, rounded: bool = False) -> Column:
    """Nanoseconds of a tick; cut off, or rounded."""
    ns = F.lit(1e9) / hz
    return (F.round(ns) if rounded else ns).cast("bigint")


def element_count(dims: Column) -> Column:
    """The product of the dimensions; -1 where it exceeds 64 bits."""
    return F.coalesce(F.aggregate(dims, F.lit(1).cast("bigint"), lambda a, d: F.try_multiply(a, d.cast("bigint"))), F.lit(-1).cast("bigint"))


def align_up(size: Column, to: int) -> Column:
    return F.expr("0L") + ((size + (to - 1)) - F.pmod(size + (to - 1), F.lit(to)))


def format_of(path: Column, head: Column) -> Column:
    """A file's format by its extension, else by its first bytes."""
    low = F.lower(path)
    return F.when(low.endswith(".npz"), "npz").when(low.endswith(".h5") | low.endswith(".hdf5"), "hdf5").when(low.endswith(".parquet"), "parquet").when(F.substring(head, 1, 4) == F.lit(b"SHRD"), "container").when(F.substring(head, 1, 4) == F.lit(b"PK\x03\x04"), "npz").when(F.substring(head, 1, 4) == F.lit(b"\x89HDF"), "hdf5").when(F.substring(head, 1, 4) == F.lit(b"PAR1"), "parquet").otherwise("unknown")


#: Content types by number; from ``USER_TYPES`` on they are the user's.
CONTENT_TYPES = {1: "tensor", 2: "json", 5: "text", 6: "image", 7: "audio", 8: "video", 9: "proto", 10: "blob", 12: "tensor_v3", 13: "anchor_shared", 14: "delta_expert", 15: "codebook_shared", 16: "expert_indices", 17: "column"}
USER_TYPES = 0x8000
#: Roles of a container by number.
ROLES = {1: "model", 2: "sample", 3: "panel", 4: "manifest", 5: "episode", 6: "universal_model", 8: "column"}


def content_type_name(number: Column) -> Column:
    user = F.concat(F.lit("user:"), (number - USER_TYPES).cast("string"))
    return F.when(number >= USER_TYPES, user).otherwise(F.coalesce(_lookup(number.cast("int"), CONTENT_TYPES), F.lit("unknown")))


def role_name(number: Column) -> Column:
    return F.coalesce(_lookup(number.cast("int"), ROLES), F.concat(F.lit("unknown:"), number.cast("string")))


def file_stem(path: Column) -> Column:
    return F.regexp_extract(F.substring_index(path, "/", -1), r"^(.*?)(\.[^.]*)?$", 1)


def episode_of_file(path: Column) -> Column:
    """The second part of a stem of four or more parts between dashes, else the stem."""
    parts = F.split(file_stem(path), "-")
    return F.when(F.size(parts) >= 4, F.get(parts, F.lit(1))).otherwise(file_stem(path))
