"""Tensor schemas: building, encoding, decoding and a predefined one; links of quantised tensors."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import DTYPE_SIZES, PACKED_BITS


@dataclass(frozen=True)
class TensorSpec:
    """What a tensor whose name fits ``pattern`` must be; -1 is any dimension, no dtype any dtype."""

    pattern: str
    dtype: str | None = None
    shape: tuple[int, ...] | None = None
    optional: bool = False


@dataclass(frozen=True)
class Schema:
    """An ordered list of specs; a tensor's is the first that fits."""

    name: str
    version: int = 1
    specs: tuple[TensorSpec, ...] = field(default=())

    def tensor(self, pattern: str, dtype: str | None = None, shape: list[int] | tuple[int, ...] | None = None, optional: bool = False) -> Schema:
        """This schema with one more spec."""
        if not pattern:
            raise ValueError("a spec needs a pattern")
        if dtype is not None and dtype not in DTYPE_SIZES and dtype not in PACKED_BITS:
            raise ValueError(f"unknown dtype {dtype}")
        if shape is not None and any(d < -1 for d in shape):
            raise ValueError("a dimension is -1 or a size")
        return replace(self, specs=(*self.specs, TensorSpec(pattern, dtype, None if shape is None else tuple(shape), optional)))

    def rules(self) -> list[tuple]:
        """The specs as ``catalog.schema_errors`` takes them."""
        return [(s.pattern, s.dtype, None if s.shape is None else list(s.shape), s.optional) for s in self.specs]

    def encode(self) -> bytes:
        rows = [{"pattern": s.pattern, "dtype": s.dtype, "shape": s.shape, "optional": s.optional} for s in self.specs]
        return json.dumps({"name": self.name, "version": self.version, "tensors": rows}, separators=(",", ":")).encode()

    @classmethod
    def decode(cls, data: bytes) -> Schema:
        """ValueError for anything that ``encode`` doesn't make."""
        try:
            told = json.loads(data)
            schema = cls(str(told["name"]), int(told["version"]))
            for t in told["tensors"]:
                schema = schema.tensor(t["pattern"], t["dtype"], t["shape"], bool(t["optional"]))
        except (KeyError, TypeError, UnicodeDecodeError, json.JSONDecodeError) as e:
            raise ValueError(f"no schema: {e}") from None
        return schema


#: A decoder-only language model's weights and their dimensions ("h" is
#: the hidden size, -1 any size), once and in each layer.
MODEL_WEIGHTS = (("embed_tokens", (-1, "h")), ("norm", ("h",)))
LAYER_WEIGHTS = (
    ("self_attn.q_proj", ("h", "h")), ("self_attn.k_proj", (-1, "h")), ("self_attn.v_proj", (-1, "h")), ("self_attn.o_proj", ("h", "h")),
    ("mlp.gate_proj", (-1, "h")), ("mlp.up_proj", (-1, "h")), ("mlp.down_proj", ("h", -1)), ("input_layernorm", ("h",)), ("post_attention_layernorm", ("h",)),
)
HEAD_WEIGHT = ("lm_head", (-1, "h"))


def language_model(name: str, hidden: int, layers: int, dtype: str = "f32") -> Schema:
    """The schema of a decoder-only language model; every weight is required."""
    named = [(f"model.{n}", dims) for n, dims in MODEL_WEIGHTS] + [(f"model.layers.{i}.{n}", dims) for i in range(layers) for n, dims in LAYER_WEIGHTS] + [HEAD_WEIGHT]
    specs = (TensorSpec(f"{n}.weight", dtype, tuple(hidden if d == "h" else d for d in dims)) for n, dims in named)
    return Schema(name, specs=tuple(specs))


def quantised_tensors(records: DataFrame, tensors: DataFrame) -> DataFrame:
    """Each quantised tensor with its auxiliary tensors, a row for each role, and whether they are there.

    ``records``: tensor, scheme, group_size, orig_dtype and aux, an array of
    (role, name); ``tensors``: name. A record without auxiliary tensors has one row
    with null role.
    """
    rows = records.select("tensor", "scheme", "group_size", "orig_dtype", F.explode_outer("aux").alias("a"))
    rows = rows.select("tensor", "scheme", "group_size", "orig_dtype", F.col("a.role").alias("role"), F.col("a.name").alias("aux_tensor"))
    there = tensors.select(F.col("name").alias("aux_tensor"), F.lit(True).alias("_there")).distinct()
    return rows.join(there, "aux_tensor", "left").withColumn("present", F.when(F.col("aux_tensor").isNotNull(), F.coalesce("_there", F.lit(False)))).drop("_there")
