"""Operator vectors, malformed containers, streams, and every query against its oracle."""

import collections
import os
import struct

import pytest
from pyspark.sql import functions as F

from episodeflow.functions import binary as B
from episodeflow.functions import names as N
from episodeflow.operators import chunks as K
from episodeflow.operators import episodes as E
from episodeflow.operators import residual as R
from episodeflow.plans import queries as Q
from episodeflow.sources import container as C
from episodeflow.sources import npz

SF = "/root/testdata/sf0.001"


def steps(spark, *episodes):
    return spark.createDataFrame([(e, t, float(x)) for e, xs in enumerate(episodes) for t, x in enumerate(xs)], "episode_id int, t bigint, x double")


def column(df, name, by="episode_id"):
    out = collections.defaultdict(list)
    for r in df.orderBy(by, "t").collect():
        out[r[by]].append(r[name])
    return dict(out)


# --- residuals ----------------------------------------------------------------------------


def test_sign2nd_diff_vectors(spark):
    got = column(R.sign2nd_diff(steps(spark, [0, 2, 0], [2, 0, 2], [0, 1, 2, 3], [1, 2], [0, float("nan"), 0]), "x"), "residual")
    assert got == {0: [0, 1, 0], 1: [0, -1, 0], 2: [0, 0, 0, 0], 3: [0, 0], 4: [0, 0, 0]}


@pytest.mark.parametrize("block", [1, 2, 3, 7])
def test_sign2nd_diff_in_blocks(spark, block):
    df = steps(spark, [5, 1, 4, 4, 2, 8, 8, 0, 3, 1], [1], [2, 1], [])
    whole = R.sign2nd_diff(df, "x")
    assert column(R.sign2nd_diff(df, "x", block=block), "residual") == column(whole, "residual")


def test_sign2nd_diff_of_columns(spark):
    rows = [(0, 10), (0, 10), (10, 0), (0, 10), (0, 10)]
    df = spark.createDataFrame([(0, t, [float(a), float(b)]) for t, (a, b) in enumerate(rows)], "episode_id int, t bigint, v array<double>")
    assert column(R.sign2nd_diff_vector(df, "v"), "residual")[0][2] == [1, -1]


@pytest.mark.parametrize("signs", [[1, -1, 1, 1, -1, -1, 1, -1, 1, -1], [1, -1, 0, 1, -1, 1, -1, -1, 1, 0], [1] * 9])
def test_pack_and_unpack(spark, signs):
    packed = R.pack_bits(steps(spark, signs), "x")
    assert len(packed.first().packed) == 2
    back = R.unpack_bits(packed.withColumn("n", F.lit(len(signs))), "n")
    assert column(back, "sign")[0] == [1 if s > 0 else -1 for s in signs]


def test_golden_residual_bytes(spark):
    signs = [0, 0, 0, 0, 1, -1, 0, 1, 0, 0]
    assert bytes(R.pack_bits(steps(spark, signs), "x").first().packed) == b"\x90\x00"


def test_quantise_and_rounding(spark):
    df = steps(spark, [0.1 * i for i in range(100)]).withColumn("omen", F.col("x") + 0.01)
    q = R.reconstruct(R.quantise(df, "x", "omen", 32), "omen")
    assert q.select("win").distinct().count() == 4
    assert q.agg(F.max(F.abs(F.col("reconstructed") - F.col("x")))).first()[0] <= 0.01
    ties = steps(spark, [127, 0.5, 1.5, 2.5, -0.5, -2.5, 0]).withColumn("omen", F.lit(0.0))
    assert column(R.quantise(ties, "x", "omen"), "q")[0] == [127, 0, 2, 2, 0, -2, 0]
    assert column(R.quantise(ties, "x", "omen", half_away=True), "q")[0] == [127, 1, 2, 3, -1, -3, 0]
    flat = R.quantise(steps(spark, [1, 1]).withColumn("omen", F.col("x")), "x", "omen")
    assert column(flat, "scale")[0] == [1.0, 1.0] and column(flat, "q")[0] == [0, 0]


# --- episodes and chunks ------------------------------------------------------------------


@pytest.mark.parametrize("n,window,stride,starts", [(64, 32, 16, [0, 16, 32]), (10, 32, 16, [0]), (33, 32, 16, [0]), (48, 32, 16, [0, 16])])
def test_window_pool(spark, n, window, stride, starts):
    df = steps(spark, range(n)).withColumn("v", F.array("x"))
    got = sorted((r.window_start, r.window_end, r.window_id, r.embedding[0]) for r in E.window_pool(df, "v", window, stride).collect())
    assert got == [(s, min(s + window, n), f"0_w{s}", (s + min(s + window, n) - 1) / 2) for s in starts]


def test_boundary_flags(spark):
    df = spark.createDataFrame([(0, 0, False, False), (0, 1, True, False), (0, 2, False, False), (0, 3, False, True), (0, 4, False, False)], "episode_id int, t bigint, terminated boolean, truncated boolean")
    flags = E.boundary_flags(df)
    assert column(flags, "is_first")[0] == [True, False, True, False, True]
    assert column(flags, "is_last")[0] == [False, True, False, True, True]


def test_chunks_and_continuity(spark):
    whole = K.manifest(steps(spark, range(20)), 5)
    rows = sorted(whole.collect(), key=lambda r: r.chunk_index)
    assert [(r.t_start, r.t_end, r.total_chunks) for r in rows] == [(0, 4, 4), (5, 9, 4), (10, 14, 4), (15, 19, 4)] and rows[1].uri == "0_chunk_0001.bin"
    totals = whole.groupBy("episode_id").agg(F.sum("length_t").alias("total_timesteps"))
    rules = lambda df, t=totals: sorted(r.rule for r in K.continuity_errors(df, t).collect())
    assert rules(whole) == [] and rules(whole.limit(0)) == []
    assert "index" in rules(whole.where("chunk_index <> 1"))
    assert "index" in rules(whole.unionByName(whole.where("chunk_index = 2")))
    assert rules(whole.withColumn("t_start", F.col("t_start") + (F.col("chunk_index") == 2).cast("int"))) == ["range"]
    assert rules(whole, totals.withColumn("total_timesteps", F.lit(999).cast("bigint"))) == ["total"]


def test_round_trip_of_shapes(spark):
    df = steps(spark, [3, 1, 2], [5])
    back = E.from_episodic(E.to_episodic(df, ["x"]), ["x"])
    assert column(back, "x") == {0: [3.0, 1.0, 2.0], 1: [5.0]}


def test_channel_projection(spark):
    names = ["meta/episode", "time/ticks", "reward", "done", "signal/state", "signal/pixels", "action/ctrl", "action/aux", "omen/state/m", "residual/state/sign2nddiff", "own/thing"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    keep = lambda a: {r.name for r in df.where(N.keep_channels(F.col("name"), a)).collect()}
    always = {"meta/episode", "time/ticks", "reward", "done", "own/thing"}
    assert keep(["state", "ctrl"]) == always | {"signal/state", "action/ctrl", "residual/state/sign2nddiff"}
    assert keep([]) == always and keep(["state/m"]) == always | {"omen/state/m"}


def test_names_and_globs(spark):
    df = spark.createDataFrame([("layers.3.w", "signal/obs/rgb"), ("blocks.1.attn.k", "reward")], "a string, b string")
    got = df.select(N.matches_glob(F.col("a"), "layers.*.w"), N.matches_glob(F.col("a"), "blocks.**.k"), N.layer_number(F.col("a")), N.path_parent(F.col("b")), N.path_base(F.col("b")), N.channel_of(F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(True, False, 3, "signal/obs", "rgb", "obs/rgb"), (False, True, 1, "", "reward", "")]


# --- bytes --------------------------------------------------------------------------------


def test_checksum_vectors():
    assert B.crc32c(b"hello") == 0x9A71BB4C
    assert B.name_hash("signal/obs") == 0x86F8C8413116A0AE and B.name_hash("meta/manifest") == 0x9A191DCD325813D3
    data = os.urandom(5001)
    crc = 0xFFFFFFFF
    for b in data:
        crc = crc >> 8 ^ B._CRC[(crc ^ b) & 0xFF]
    assert B.crc32c(data) == crc ^ 0xFFFFFFFF


@pytest.mark.parametrize("data", [b"", b"a" * 5000, os.urandom(3000), b"abcabcabd" * 400, bytes(range(256)) * 9])
def test_lz4_blocks(data):
    assert B.lz4_block_decode(B.lz4_block_encode(data), len(data)) == data
    with pytest.raises(ValueError):
        B.lz4_block_decode(B.lz4_block_encode(data), len(data) + 1)


def test_tensor_bytes():
    import numpy as np

    assert B.encode_tensor([1, 2, 3, 4], "bf16") == struct.pack("<4H", 0x3F80, 0x4000, 0x4040, 0x4080)
    assert B.decode_tensor(struct.pack("<2H", 0x3F80, 0x7FC0), "bf16")[0] == 1 and np.isnan(B.decode_tensor(struct.pack("<H", 0x7FC0), "bf16"))[0]
    assert B.decode_tensor(B.encode_tensor([-1, 0, 1, 2147483647], "i32"), "i32").tolist() == [-1, 0, 1, 2147483647]
    assert B.decode_tensor(b"\0\2", "bool").tolist() == [False, True]
    assert B.tensor_v1_header(B.tensor_v1_encode([1, 2], 1, "f32", [2]))[1:] == ((2,), 12)
    with pytest.raises(ValueError):
        B.decode_tensor(b"abc", "f32")


# --- containers ---------------------------------------------------------------------------


@pytest.mark.parametrize("codec", ["none", "zstd", "lz4"])
@pytest.mark.parametrize("alignment", [0, 16, 32, 64])
def test_container_round_trip(codec, alignment):
    blocks = {"signal/obs": b"\1" * 3000, "reward": b"ab", "done": b"", "meta/episode": b"{}"}
    data = C.write_container(blocks, codec, alignment)
    head, entries = C.read_entries(data)
    assert [e["name"] for e in entries] == sorted(blocks) and head["role"] == C.ROLE_EPISODE
    assert {e["name"]: C.read_block(data, e) for e in entries} == {k: (v, True) for k, v in blocks.items()}
    assert not alignment or all(e["offset"] % alignment == 0 for e in entries)


def broken(at, value):
    data = bytearray(C.write_container({"a": b"x" * 100, "b": bytes(range(100))}, "none"))
    data[at : at + len(value)] = value
    return bytes(data)


ENTRY0 = 64
MALFORMED = {
    "short": b"SHRD", "magic": broken(0, b"XXXX"), "version": broken(4, b"\x09"), "entry size": broken(10, b"\x10\0"), "count": broken(12, b"\xff\xff\xff\xff"),
    "names": broken(16, struct.pack("<Q", 1 << 40)), "total": broken(40, struct.pack("<Q", 7)), "name offset": broken(ENTRY0 + 8, struct.pack("<I", 9999)), "data offset": broken(ENTRY0 + 16, struct.pack("<Q", 1 << 50)),
    "disk size": broken(ENTRY0 + 24, struct.pack("<Q", 1 << 40)), "sizes": broken(ENTRY0 + 32, struct.pack("<Q", 5)), "overlap": broken(ENTRY0 + 48 + 16, struct.pack("<Q", 192)), "not utf-8": broken(64 + 96, b"\xff"), "alignment": broken(8, b"\x05"), "codec": broken(9, b"\x09"),
}


@pytest.mark.parametrize("name", sorted(MALFORMED))
def test_malformed_containers(name):
    with pytest.raises(C.Broken):
        C.read_entries(MALFORMED[name])


def test_container_files(spark, tmp_path):
    df = spark.createDataFrame([(e, t, [float(t), float(e)], 0.5 * t, int(t == 4)) for e in (1, 2) for t in range(5)], "episode_id int, t bigint, v array<double>, reward double, done int")
    columns = {"signal/state": ("v", "f32"), "uncert/state/m/std": ("v", "f64"), "reward": ("reward", "f32"), "done": ("done", "u8")}
    C.write_files(C.pack_episodes(df, columns), str(tmp_path / "out"))
    assert sorted(os.listdir(tmp_path / "out")) == ["1.bin", "2.bin"]
    blocks = C.read_blocks(spark, str(tmp_path / "out"))
    state = {(r.file.rsplit("/", 1)[1], r.t): r.value for r in C.decode_steps(blocks).where("name = 'signal/state'").collect()}
    assert state == {(f"{e}.bin", t): [float(t), float(e)] for e in (1, 2) for t in range(5)}
    assert {(r.checked, r.failures, r.hash_failures) for r in C.verify_blocks(blocks).collect()} == {(7, 0, 0)}
    assert C.catalog(spark, str(tmp_path / "out")).where("name = 'done'").first().orig_size == 5
    bad = (tmp_path / "out" / "1.bin").read_bytes()
    (tmp_path / "bad.bin").write_bytes(bad[:-1] + bytes([bad[-1] ^ 1]))
    (tmp_path / "worse.bin").write_bytes(b"no container")
    got = C.read_blocks(spark, str(tmp_path / "*.bin"), permissive=True, names=["uncert/state/m/std"]).collect()
    assert sum(r.error is not None for r in got) >= 1
    with pytest.raises(Exception, match="no container|cut short"):
        C.read_blocks(spark, str(tmp_path / "worse.bin")).collect()


def test_metadata_and_command_line(spark, tmp_path, capsys):
    from episodeflow.__main__ import main

    data = C.with_metadata(C.write_container({"done": b"ab"}), b'{"tags":["x"]}')
    (tmp_path / "a.bin").write_bytes(data)
    (tmp_path / "b.bin").write_bytes(C.write_container({"done": b"cd"}))
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert {r.file.rsplit("/", 1)[1]: r.metadata for r in C.file_metadata(files).collect()} == {"a.bin": '{"tags":["x"]}', "b.bin": None}
    assert main(["inspect", str(tmp_path)]) == 0 and main(["verify", "--strict", str(tmp_path)]) == 0
    (tmp_path / "c.bin").write_bytes(b"SHRD")
    assert main(["verify", str(tmp_path)]) == 1 and "cut short" in capsys.readouterr().out


def test_reads_by_place(spark, tmp_path):
    from episodeflow.sources.files import Memory, opened

    blocks = {"signal/a": os.urandom(200_000), "signal/b": b"\1\2" * 100_000, "signal/c": b"x" * 10}
    for codec in ("none", "zstd", "lz4"):
        data = C.write_container(blocks, codec)
        fetched = []

        class Counted(Memory):
            def read(self, at, n):
                fetched.append(n)
                return super().read(at, n)

        head, entries = C.read_entries(Counted(data))
        assert sum(fetched) < 500
        for e in entries:
            fetched.clear()
            assert C.read_prefix(Counted(data), e, 12) == blocks[e["name"]][:12]
            assert sum(fetched) <= (10_000 if codec != "lz4" else e["disk"])
        (tmp_path / f"{codec}.bin").write_bytes(data)
        with opened(f"file:{tmp_path}/{codec}.bin", len(data)) as f:
            assert C.read_block(f, C.read_entries(f)[1][2]) == (blocks["signal/c"], True)
    (tmp_path / "a b%é.bin").write_bytes(data)
    read = lambda **o: {(r.file.rsplit("/", 1)[1], r.name): bytes(r.payload) for r in C.read_blocks(spark, str(tmp_path), **o).collect()}
    assert read() == read(access="whole") and len(read(names=["signal/c"])) == 4
    assert set(read(first_bytes=5, names=["signal/b"]).values()) == {b"\1\2\1\2\1"}


def test_convert_and_command_line(spark, tmp_path, capsys):
    from episodeflow.__main__ import main
    from episodeflow.sources import dispatch

    rows = [(e, lane, ch, t, [float(t)] * w) for e in ("a", "b") for lane, ch, w in (("signal", "arm/pos", 3), ("action", "u", 2), ("reward", "reward", 1)) for t in range(4)]
    steps = spark.createDataFrame(rows, "episode_id string, lane string, channel string, t bigint, value array<double>")
    at = lambda n: str(tmp_path / n)
    dispatch.save(steps, at("p"), "parquet")
    read = lambda path, f=None: {(r.episode_id, r.lane, r.channel, r.t, tuple(r.value)) for r in dispatch.load(spark, path, f).collect()}
    want = {(*r[:4], tuple(r[4])) for r in rows}
    assert main(["convert", at("p"), at("c")]) == 0 and read(at("c")) == want
    assert main(["export", at("c"), at("e")]) == 0 and read(at("e")) == want
    assert main(["convert", at("c"), at("x"), "--to", "hdf5"]) == 2 and main(["convert", at("nowhere"), at("x")]) == 1
    assert main(["convert", at("c"), at("x"), "--format", "npz"]) == 1
    flat = steps.where("lane <> 'action'").withColumn("channel", F.regexp_replace("channel", "arm/pos", "state"))
    dispatch.save(flat, at("n"), "npz")
    assert {(c, t, v) for _, _, c, t, v in read(at("n"))} == {("state", t, (float(t),) * 3) for t in range(4)} | {("reward", t, (float(t),)) for t in range(4)}
    for name in dispatch.UNSUPPORTED:
        with pytest.raises(NotImplementedError):
            dispatch.load(spark, at("c"), name)


def test_schemas():
    from episodeflow.operators.schema import Schema, language_model

    schema = language_model("m", 8, 2)
    assert Schema.decode(schema.encode()) == schema and len(schema.specs) == 2 + 2 * 9 + 1
    for wrong in (b"{}", b"x", b'{"name":"a","version":1,"tensors":[{"pattern":""}]}'):
        with pytest.raises(ValueError):
            Schema.decode(wrong)
    with pytest.raises(ValueError):
        schema.tensor("a", "f99")


def test_segments_and_tensors():
    parts = [b"", b"ab", b"x" * 300]
    assert B.unpack_segments(B.pack_segments(parts)) == parts
    with pytest.raises(ValueError):
        B.unpack_segments(B.pack_segments(parts)[:-1])
    data = B.tensor_v1_encode([1.5, 2.5], 1, "f32", [2, 1])
    kind, dims, values = B.tensor_v1_decode(data, {1: "f32"})
    assert (kind, dims, values.tolist()) == ("f32", (2, 1), [1.5, 2.5])
    for wrong in (data[:-1], data + b"x", data[:6]):
        with pytest.raises(ValueError):
            B.tensor_v1_decode(wrong, {1: "f32"})


def test_npz(spark, tmp_path):
    import numpy as np

    arrays = {"image": np.zeros((4, 2, 2), np.uint8), "action": np.ones((4, 3)), "reward": np.arange(4.0), "is_last": np.array([0, 0, 0, 1], bool), "is_terminal": np.zeros(4, bool)}
    (tmp_path / "20200101-ab12-4-x.npz").write_bytes(npz.npz_bytes(arrays))
    rows = npz.read_npz(spark, str(tmp_path)).collect()
    assert {r.episode_id for r in rows} == {"ab12"} and collections.Counter(r.channel for r in rows) == {"image": 4, "action": 4, "reward": 4}
    assert [r.is_last and not r.is_terminal for r in sorted((r for r in rows if r.channel == "reward"), key=lambda r: r.t)] == [False, False, False, True]


# --- streams ------------------------------------------------------------------------------


def test_recording_stream(spark, tmp_path):
    from episodeflow.streaming import recorder as S

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))

    def put(*rows):
        spark.createDataFrame(rows, S.STEP.replace("ts timestamp", "ts timestamp")).write.mode("append").parquet(source)

    step = lambda e, t, done=False: (e, t, "x", [float(t)], 1.0, done, None)
    put(step("a", 1), step("a", 0), step("b", 0), ("a", 0, "other", [0.0], 1.0, False, None))
    for more in ([step("a", 2, True)], [step("c", i, i == 9) for i in range(10)]):
        good, refused = S.split_valid(S.read_steps(spark, source), {"x": 1})
        S.write_episodes(S.record(good, max_steps=5), out, check).awaitTermination()
        put(*more)
    good, refused = S.split_valid(S.read_steps(spark, source), {"x": 1})
    S.write_episodes(S.record(good, max_steps=5), out, check).awaitTermination()
    got = {r.episode_id: r for r in spark.read.parquet(out).collect()}
    assert set(got) == {"a", "c"} and got["a"].ts == [0, 1, 2] and got["a"].total_reward == 3.0 and (got["c"].status, got["c"].length, got["c"].ts) == ("too_long", 10, [])


def test_recording_to_containers_with_aborts(spark, tmp_path):
    from episodeflow.sources import dispatch
    from episodeflow.streaming import recorder as S

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    step = lambda e, t, ch="x", done=False: (e, t, ch, [float(t)], 1.0, done, None)
    batches = [[step("a", 0), step("a", 1), step("b", 0)], [step("b", 1, S.ABORT), step("a", 2, "x", True)], [step("b", 5), step("b", 6, "x", True)]]
    for rows in batches:
        spark.createDataFrame(rows, S.STEP).write.mode("append").parquet(source)
        good, _ = S.split_valid(S.read_steps(spark, source), {"x": 1})
        S.write_containers(S.record(good, flush_steps=1), out, check).awaitTermination()
        assert not os.path.isdir(out) or not [f for f in os.listdir(out) if not f.endswith(".bin")]
    got = collections.defaultdict(list)
    for r in sorted(dispatch.load(spark, out).where("channel = 'x'").collect(), key=lambda r: r.t):
        got[r.episode_id].append(r.value[0])
    assert got == {"a": [0.0, 1.0, 2.0], "b": [5.0, 6.0]}


def test_windows_and_sessions_of_a_stream(spark, tmp_path):
    from datetime import datetime, timedelta

    from episodeflow.streaming import recorder as S

    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    rows = [("a", i, "x", [0.0], 1.0, False, at(m)) for i, m in enumerate([0, 1, 2, 20, 21, 90])]
    spark.createDataFrame(rows, S.STEP).write.parquet(str(tmp_path / "in"))
    results = {}
    for name, f in (("tumbling", lambda s: S.windowed_rewards(s, "10 minutes")), ("sliding", lambda s: S.windowed_rewards(s, "10 minutes", "5 minutes")), ("session", lambda s: S.session_rewards(s, "10 minutes"))):
        stream = f(S.read_steps(spark, str(tmp_path / "in")))
        stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        results[name] = sorted(((r.w.start.hour * 60 + r.w.start.minute, r.n) for r in spark.table(name).collect()))
    assert results["tumbling"] == [(0, 3), (20, 2)]
    assert len(results["sliding"]) == 4 and sorted(n for _, n in results["sliding"]) == [2, 2, 3, 3]
    assert results["session"] == [(0, 3), (20, 2)]


# --- all queries --------------------------------------------------------------------------


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query_against_oracle(spark, duck, name):
    rows = Q.QUERIES[name](spark, SF)
    columns = sorted(rows.columns)
    got = collections.Counter(repr(tuple(r[c] for c in columns)) for r in rows.collect())
    if name not in Q.ORACLES:
        assert got
        return
    want = duck.sql(Q.ORACLES[name])
    assert sorted(want.columns) == columns
    place = [want.columns.index(c) for c in columns]
    assert got == collections.Counter(repr(tuple(r[i] for i in place)) for r in want.fetchall())
