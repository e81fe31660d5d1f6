"""The named queries over the test tables, each beside its DuckDB oracle.

A query's name is its inventory number and what it does. Sums and means are
rounded to digits at which no exact value of the data can tie.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import catalog as C
from ..operators import chunks as K
from ..operators import episodes as E
from ..operators import residual as R
from ..operators import schema as S
from ..operators import steps as P
from .views import BL, EV, LI, OM, blocks, event_steps, item_steps, predicted_steps, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


SIGN = "CASE WHEN {p} IS NULL OR {n} IS NULL THEN 0 WHEN 2*({x})-({p})-({n}) > 0 THEN 1 WHEN 2*({x})-({p})-({n}) < 0 THEN -1 ELSE 0 END"
S2 = f"WITH {EV}, r AS (SELECT *, lag(x) OVER w AS p, lead(x) OVER w AS n FROM ev WINDOW w AS (PARTITION BY episode_id ORDER BY t)), sg AS (SELECT episode_id, t, {SIGN.format(x='x', p='p', n='n')} AS residual FROM r)"


@query("w02_sign2nd_diff", f"{S2} SELECT episode_id, t, residual FROM sg")
def w02(spark, d):
    return R.sign2nd_diff(event_steps(spark, d), "x").select("episode_id", "t", "residual")


@query("w03_sign2nd_diff_vector", f"WITH {LI}, u AS (SELECT episode_id, t, unnest(range(4)) AS dim, unnest(v) AS x FROM li), r AS (SELECT *, lag(x) OVER w AS p, lead(x) OVER w AS n FROM u WINDOW w AS (PARTITION BY episode_id, dim ORDER BY t)) SELECT episode_id, t, dim, {SIGN.format(x='x', p='p', n='n')} AS residual FROM r")
def w03(spark, d):
    rows = R.sign2nd_diff_vector(item_steps(spark, d), "v")
    return rows.select("episode_id", "t", F.posexplode("residual").alias("dim", "residual"))


@query("w04_error_residual", f"WITH {OM}, e AS (SELECT episode_id, t, x - omen AS x FROM om), r AS (SELECT *, lag(x) OVER w AS p, lead(x) OVER w AS n FROM e WINDOW w AS (PARTITION BY episode_id ORDER BY t)) SELECT episode_id, t, {SIGN.format(x='x', p='p', n='n')} AS residual FROM r")
def w04(spark, d):
    return R.error_residual(predicted_steps(spark, d), "x", "omen").select("episode_id", "t", "residual")


QZ = f"WITH {OM}, q0 AS (SELECT episode_id, t, omen, x - omen AS delta, t // 32 AS win FROM om), q1 AS (SELECT *, max(abs(delta)) OVER (PARTITION BY episode_id, win) AS m FROM q0), q2 AS (SELECT *, CASE WHEN m = 0 THEN 1.0::DOUBLE ELSE m / 127.0::DOUBLE END AS scale FROM q1)"


@query("w05_quantise", f"{QZ} SELECT episode_id, t, win, round(scale, 9) AS scale, greatest(-127, least(127, round_even(delta / scale, 0)))::INT AS q FROM q2")
def w05(spark, d):
    return R.quantise(predicted_steps(spark, d), "x", "omen", 32).select("episode_id", "t", "win", F.round("scale", 9).alias("scale"), "q")


@query("w05_quantise_half_away", f"{QZ} SELECT episode_id, t, greatest(-127, least(127, round(delta / scale, 0)))::INT AS q FROM q2")
def w05b(spark, d):
    return R.quantise(predicted_steps(spark, d), "x", "omen", 32, half_away=True).select("episode_id", "t", "q")


@query("w06_reconstruct", f"{QZ} SELECT episode_id, t, round(omen + greatest(-127, least(127, round_even(delta / scale, 0)))::INT * scale, 7) AS reconstructed FROM q2")
def w06(spark, d):
    rows = R.reconstruct(R.quantise(predicted_steps(spark, d), "x", "omen", 32), "omen")
    return rows.select("episode_id", "t", F.round("reconstructed", 7).alias("reconstructed"))


@query("a03_window_max_abs", f"WITH {OM} SELECT episode_id, t // 32 AS win, round(max(abs(x - omen)), 9) AS max_abs FROM om GROUP BY episode_id, t // 32")
def a03(spark, d):
    return R.window_scales(predicted_steps(spark, d), "x", "omen", 32).select("episode_id", "win", F.round("max_abs", 9).alias("max_abs"))


PACK = f"{S2}, b AS (SELECT episode_id, t // 8 AS byte, sum(CASE WHEN residual > 0 THEN (1 << (t % 8)::INT) ELSE 0 END)::INT AS v FROM sg GROUP BY ALL)"


@query("a04_pack_bits", f"{PACK} SELECT episode_id, string_agg(printf('%02X', v), '' ORDER BY byte) AS packed FROM b GROUP BY episode_id")
def a04(spark, d):
    return R.pack_bits(R.sign2nd_diff(event_steps(spark, d), "x"), "residual").select("episode_id", F.hex("packed").alias("packed"))


def _unpacked(spark, d, edge):
    signs = R.sign2nd_diff(event_steps(spark, d), "x")
    packed = R.pack_bits(signs, "residual").join(E.lengths(signs), "episode_id")
    return R.unpack_bits(packed, "length_t", edge_zero=edge).select("episode_id", "t", "sign")


@query("f_arr8_unpack_bits", f"{S2} SELECT episode_id, t, CASE WHEN residual > 0 THEN 1 ELSE -1 END AS sign FROM sg")
def f_arr8(spark, d):
    return _unpacked(spark, d, False)


@query("f_arr9_unpack_edges", f"{S2} SELECT episode_id, t, CASE WHEN t = 0 OR t = max(t) OVER (PARTITION BY episode_id) THEN 0 WHEN residual > 0 THEN 1 ELSE -1 END AS sign FROM sg")
def f_arr9(spark, d):
    return _unpacked(spark, d, True)


@query("f_arr10_mask_round_trip", f"WITH {EV} SELECT episode_id, t, terminated AS mask FROM ev")
def f_arr10(spark, d):
    steps = event_steps(spark, d).withColumn("bit", F.col("terminated").cast("int"))
    packed = R.pack_bits(steps, "bit").join(E.lengths(steps), "episode_id")
    return R.unpack_bits(packed, "length_t").select("episode_id", "t", (F.col("sign") == 1).alias("mask"))


@query("f_arr6_dequantise", "SELECT l_orderkey, l_linenumber, l_partkey, (l_linenumber % 2) AS \"row\", l_quantity::BIGINT * CASE WHEN l_linenumber % 2 = 0 THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END AS dequantised FROM lineitem")
def f_arr6(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_linenumber") % 2).alias("row"), F.col("l_quantity").cast("bigint").alias("v"), F.array(F.lit(0.5), F.lit(0.25)).alias("scales"))
    return R.dequantise_rows(rows, "v", "scales", "row").select("l_orderkey", "l_linenumber", "l_partkey", "row", "dequantised")


@query("w07_w08_boundary_flags", f"WITH {EV} SELECT episode_id, t, coalesce(lag(terminated OR truncated) OVER w, true) AS is_first, (terminated OR truncated OR lead(1) OVER w IS NULL) AS is_last FROM ev WINDOW w AS (PARTITION BY episode_id ORDER BY t)")
def w07(spark, d):
    return E.boundary_flags(event_steps(spark, d)).select("episode_id", "t", "is_first", "is_last")


@query("w09_window_pool", f"""WITH {LI}, n AS (SELECT episode_id, max(t) + 1 AS n FROM li GROUP BY 1), s AS (SELECT episode_id, n, unnest(range(0, greatest(n - 3 + 1, 1), 2)) AS s FROM n),
u AS (SELECT s.episode_id, s, least(s + 3, n) AS e, unnest(range(4)) AS dim, unnest(v) AS x FROM s JOIN li ON li.episode_id = s.episode_id AND t >= s AND t < s + 3)
SELECT episode_id, s AS window_start, e AS window_end, episode_id || '_w' || s AS window_id, dim, round(avg(x), 8) AS m FROM u GROUP BY ALL""")
def w09(spark, d):
    rows = E.window_pool(item_steps(spark, d), "v", 3, 2)
    return rows.select("episode_id", "window_start", "window_end", "window_id", F.posexplode("embedding").alias("dim", "m")).withColumn("m", F.round("m", 8))


@query("w10_w11_ticks", f"WITH {EV} SELECT episode_id, event_id, t, round(t / 30.0::DOUBLE, 9) AS seconds FROM ev")
def w10(spark, d):
    return event_steps(spark, d).select("episode_id", "event_id", "t", F.round(E.wall_time(F.col("t"), 30.0), 9).alias("seconds"))


@query("a01_total_reward", f"WITH {EV} SELECT episode_id, round(sum(x), 4) AS total_reward FROM ev GROUP BY 1")
def a01(spark, d):
    return E.total_reward(event_steps(spark, d), "x").select("episode_id", F.round("total_reward", 4).alias("total_reward"))


@query("a02_mean_pool", f"WITH {LI}, u AS (SELECT episode_id, unnest(range(4)) AS dim, unnest(v) AS x FROM li) SELECT episode_id, dim, round(avg(x), 8) AS m FROM u GROUP BY ALL")
def a02(spark, d):
    return E.mean_pool(item_steps(spark, d), "v").select("episode_id", F.posexplode("embedding").alias("dim", "m")).withColumn("m", F.round("m", 8))


@query("a05_dataset_metadata", f"WITH {LI}, e AS (SELECT episode_id, count(*) AS n FROM li GROUP BY 1) SELECT count(*) AS num_episodes, sum(n)::BIGINT AS total_timesteps, 'quantity,price' AS observation_keys, true AS has_rewards FROM e")
def a05(spark, d):
    episodes = E.lengths(item_steps(spark, d)).withColumn("keys", F.lit("quantity,price")).withColumn("rewards", F.lit(True))
    return E.dataset_metadata(episodes, "n_steps", "keys", "rewards")


@query("a11_lengths", f"WITH {EV} SELECT episode_id, max(t) + 1 AS length_t, count(*) AS n_steps FROM ev GROUP BY 1")
def a11(spark, d):
    return E.lengths(event_steps(spark, d))


@query("a12_reward_summary", f"WITH {EV} SELECT episode_id, round(avg(x), 8) AS mean_reward, count(*) FILTER (terminated) AS n_terminal FROM ev GROUP BY 1")
def a12(spark, d):
    return E.reward_summary(event_steps(spark, d), "x", "terminated").withColumn("mean_reward", F.round("mean_reward", 8))


@query("k10_s20_episodic", f"WITH {EV} SELECT episode_id, count(*) AS length, sha256(string_agg(event_type, ',' ORDER BY t)) AS types_sha FROM ev GROUP BY 1")
def k10(spark, d):
    rows = E.to_episodic(event_steps(spark, d), ["event_type"])
    return rows.select("episode_id", E.episodic_length(F.lit(0), F.col("event_type")).cast("bigint").alias("length"), F.sha2(F.array_join("event_type", ",").cast("binary"), 256).alias("types_sha"))


@query("s19_regroup", f"WITH {EV} SELECT episode_id, t, event_type, x FROM ev")
def s19(spark, d):
    return E.from_episodic(E.to_episodic(event_steps(spark, d), ["event_type", "x"]), ["event_type", "x"])


@query("k09_flatten", f"WITH {LI} SELECT episode_id, t AS timestep, v[1] AS obs_arm_quantity, v[2] AS action_arm_price FROM li")
def k09(spark, d):
    steps = item_steps(spark, d).select("episode_id", "t", F.get("v", F.lit(0)).alias("q"), F.get("v", F.lit(1)).alias("p"))
    return E.flatten_names(steps, {"arm/quantity": "q"}, {"arm/price": "p"})


@query("k11_flat_export", f"""WITH {LI} SELECT v[1] AS "observation.state.0", v[2] AS "observation.state.1", v[3] AS "action.0", t = max(t) OVER (PARTITION BY episode_id) AS "next.done", episode_id AS episode_index, t AS frame_index, round(t / 30.0::DOUBLE, 9) AS timestamp FROM li""")
def k11(spark, d):
    from pyspark.sql import Window

    steps = item_steps(spark, d).withColumn("state", F.slice("v", 1, 2)).withColumn("act", F.slice("v", 3, 1)).withColumn("done", F.col("t") == F.max("t").over(Window.partitionBy("episode_id")))
    return E.flat_export(steps, "state", 2, "act", 1, 30.0).withColumn("timestamp", F.round("timestamp", 9))


@query("p04_metadata_filter", f"WITH {EV}, e AS (SELECT episode_id, max(t) + 1 AS length_t, round(sum(x), 4) AS total_reward, episode_id % 5 AS env_id FROM ev GROUP BY 1) SELECT * FROM e WHERE env_id = 3 AND length_t >= 10 AND total_reward BETWEEN 0 AND 1000000")
def p04(spark, d):
    steps = event_steps(spark, d)
    rows = E.lengths(steps).join(E.total_reward(steps, "x"), "episode_id").select("episode_id", "length_t", F.round("total_reward", 4).alias("total_reward"), (F.col("episode_id") % 5).alias("env_id"))
    return rows.where(E.metadata_filter(3, 10, 0, 1_000_000))


@query("f_arr4_slice", f"WITH {EV} SELECT episode_id, t - 5 AS t, x FROM ev WHERE t >= 5 AND t < 12")
def f_arr4(spark, d):
    return E.slice_steps(event_steps(spark, d), 5, 12).select("episode_id", "t", "x")


@query("f_arr3_reshape", "SELECT vec_id, unnest(range(len(embedding) // 8)) AS \"row\", round(unnest(list_transform(range(len(embedding) // 8), lambda i: list_sum(list_transform(embedding[i*8+1:i*8+8], lambda x: x::DOUBLE)))), 6) AS s FROM embeddings")
def f_arr3(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.posexplode(E.reshape(F.col("embedding"), 8)).alias("row", "v"))
    return rows.select("vec_id", F.col("row").cast("bigint").alias("row"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("s"))


@query("j02_channel_join", f"WITH {BL}, ch AS (SELECT DISTINCT 'c' || (user_id % 9) || '/click' AS channel FROM events) SELECT channel, count(name) AS n_blocks FROM ch LEFT JOIN bl ON bl.name = 'signal/' || channel GROUP BY 1")
def j02(spark, d):
    channels = table(spark, d, "events").select(F.concat(F.lit("c"), (F.col("user_id") % 9).cast("string"), F.lit("/click")).alias("channel")).distinct()
    found = channels.withColumn("name", N.block_name("signal", F.col("channel"))).join(blocks(spark, d).select("name", "entry_idx"), "name", "left")
    return found.groupBy("channel").agg(F.count("entry_idx").alias("n_blocks"))


def _lanes(spark, d):
    """Signal and prediction as long steps."""
    rows = predicted_steps(spark, d)
    lane = lambda name, model, value: F.struct(F.lit(name).alias("lane"), F.lit("x").alias("channel"), F.lit(model).alias("model_id"), F.col(value).alias("value"))
    return rows.select("episode_id", "t", F.explode(F.array(lane("signal", "", "x"), lane("omen", "ma3", "omen"))).alias("s")).select("episode_id", "t", "s.*")


@query("j03_prediction_error", f"WITH {OM} SELECT episode_id, t, round(x - omen, 7) AS error FROM om")
def j03(spark, d):
    return P.prediction_errors(_lanes(spark, d), "x", "ma3").withColumn("error", F.round("error", 7))


@query("j04_scales_join", f"{QZ}, w AS (SELECT episode_id, win, any_value(scale) AS scale FROM q2 GROUP BY ALL) SELECT q2.episode_id, t, round(greatest(-127, least(127, round_even(delta / q2.scale, 0)))::INT * w.scale, 7) AS deviation FROM q2 JOIN w USING (episode_id, win)")
def j04(spark, d):
    q = R.quantise(predicted_steps(spark, d), "x", "omen", 32)
    scales = q.groupBy("episode_id", "win").agg(F.first("scale").alias("scale"))
    return P.scaled(q, scales).select("episode_id", "t", F.round("deviation", 7).alias("deviation"))


CHUNKS = f"{LI}, ch AS (SELECT episode_id, t // 3 AS chunk_index, min(t) AS t_start, max(t) AS t_end, count(*) AS length_t FROM li GROUP BY ALL), mf AS (SELECT *, count(*) OVER (PARTITION BY episode_id) AS total_chunks, printf('%d_chunk_%04d.bin', episode_id, chunk_index) AS uri FROM ch)"


def _manifest(spark, d):
    return K.manifest(item_steps(spark, d), 3)


@query("k06_chunk_manifest", f"WITH {CHUNKS} SELECT episode_id, chunk_index, t_start, t_end, length_t, total_chunks, uri FROM mf")
def k06(spark, d):
    return _manifest(spark, d)


@query("s12_manifest_json_round_trip", f"WITH {CHUNKS} SELECT episode_id, chunk_index, uri, t_start, t_end, length_t FROM mf")
def s12(spark, d):
    return K.read_manifest(K.manifest_json(_manifest(spark, d)))


@query("s13_u2_chunks_in_order", f"WITH {LI} SELECT episode_id, t, t // 3 AS chunk_index, v[1] AS q FROM li ORDER BY episode_id, chunk_index, t")
def s13(spark, d):
    steps = K.assign_chunks(item_steps(spark, d), 3)
    return steps.select("episode_id", "t", "chunk_index", F.get("v", F.lit(0)).alias("q")).orderBy("episode_id", "chunk_index", "t")


@query("s14_load_chunk", f"WITH {LI} SELECT episode_id, t, v[1] AS q FROM li WHERE t // 3 = 1")
def s14(spark, d):
    return K.assign_chunks(item_steps(spark, d), 3).where("chunk_index = 1").select("episode_id", "t", F.get("v", F.lit(0)).alias("q"))


@query("a06_manifest_totals", f"WITH {CHUNKS} SELECT episode_id, count(*) AS total_chunks, sum(length_t)::BIGINT AS total_timesteps FROM mf GROUP BY 1")
def a06(spark, d):
    return K.manifest_totals(_manifest(spark, d))


def _broken(spark, d):
    """A manifest with faults: chunks left out, ranges shifted, and totals of the whole one."""
    whole = _manifest(spark, d)
    rows = whole.where("episode_id % 7 <> 0 or chunk_index <> 0").withColumn("t_start", F.col("t_start") + F.when((F.col("episode_id") % 5 == 0) & (F.col("chunk_index") == 1), 1).otherwise(0))
    return rows, whole.groupBy("episode_id").agg(F.sum("length_t").alias("total_timesteps"))


@query("v03_w12_continuity", f"""WITH {CHUNKS}, r AS (SELECT episode_id, chunk_index, t_start + CASE WHEN episode_id % 5 = 0 AND chunk_index = 1 THEN 1 ELSE 0 END AS t_start, t_end, length_t FROM mf WHERE episode_id % 7 <> 0 OR chunk_index <> 0),
x AS (SELECT *, row_number() OVER w - 1 AS place, lag(t_end) OVER w AS before FROM r WINDOW w AS (PARTITION BY episode_id ORDER BY chunk_index, t_start)),
g AS (SELECT episode_id, bool_or(chunk_index <> place) AS i, coalesce(bool_or(t_start <> before + 1), false) AS g, sum(length_t) AS s FROM x GROUP BY 1),
tt AS (SELECT episode_id, sum(length_t) AS total FROM mf GROUP BY 1)
SELECT episode_id, 'index' AS rule FROM g WHERE i UNION ALL SELECT episode_id, 'range' FROM g WHERE g UNION ALL SELECT episode_id, 'total' FROM g JOIN tt USING (episode_id) WHERE s <> total""")
def v03(spark, d):
    return K.continuity_errors(*_broken(spark, d))


@query("f_bin3_j06_sha256_files", "SELECT page_id::VARCHAR AS uri, sha256(html) AS sha256, page_id % 3 <> 0 AS sha_ok FROM pages")
def j06(spark, d):
    pages = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("uri"), F.col("html").cast("binary").alias("content"), "page_id")
    stated = pages.select("uri", F.sha2("content", 256).alias("sha256"), "page_id")
    files = pages.select("uri", F.when(F.col("page_id") % 3 == 0, F.concat(F.col("content"), F.lit(b"x"))).otherwise(F.col("content")).alias("content"))
    return K.check_files(stated, files).select("uri", "sha256", "sha_ok")


def _vector(spark, d):
    return table(spark, d, "embeddings").where("vec_id = 0").first()["embedding"]


COS = "SELECT list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s, e.* FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q"


@query("o04_nearest_episodes", f"SELECT vec_id AS episode_id, label, round(s, 9) AS score FROM ({COS}) ORDER BY s DESC, vec_id LIMIT 10")
def o04(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("episode_id"), "label", "embedding")
    return E.nearest_episodes(rows, _vector(spark, d), 10).select("episode_id", "label", F.round("score", 9).alias("score"))


@query("o05_nearest_filtered", f"SELECT vec_id AS episode_id, round(s, 9) AS score FROM ({COS}) WHERE label = 3 ORDER BY s DESC, vec_id LIMIT 5")
def o05(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("episode_id"), F.col("label").alias("env_id"), "embedding")
    return E.nearest_episodes(rows, _vector(spark, d), 5, E.metadata_filter(env_id=3)).select("episode_id", F.round("score", 9).alias("score"))


@query("j07_hit_to_episode", f"SELECT d.doc_id, d.source, round(s, 9) AS score FROM (SELECT vec_id, s FROM ({COS}) ORDER BY s DESC, vec_id LIMIT 10) h JOIN documents d ON d.doc_id = h.vec_id")
def j07(spark, d):
    hits = E.nearest_episodes(table(spark, d, "embeddings").withColumn("episode_id", F.col("vec_id")), _vector(spark, d), 10)
    docs = table(spark, d, "documents").select("doc_id", "source")
    return P.hit_episodes(hits.select(F.col("vec_id").alias("doc_id"), F.round("score", 9).alias("score")), docs, "doc_id")


@query("k13_vector_rows", "SELECT vec_id AS episode_id, label AS env_id, 'ep/' || vec_id || '.bin' AS file_path, len(embedding) AS dim FROM embeddings")
def k13(spark, d):
    return P.vector_rows(table(spark, d, "embeddings"), "vec_id", "label", "embedding", "ep").drop("embedding")


@query("p01_channel_projection", f"""WITH {BL}, x AS (SELECT *, split_part(name, '/', 1) AS lane, regexp_extract(name, '^[^/]*/(.*)$', 1) AS rest FROM bl)
SELECT entry_idx, name FROM x WHERE lane IN ('meta', 'time') OR lane IN ('signal', 'action', 'omen', 'uncert') AND rest IN ('c1/click', 'c2') OR lane = 'residual' AND split_part(rest, '/', 1) IN ('c1/click', 'c2')""")
def p01(spark, d):
    return blocks(spark, d).where(N.keep_channels(F.col("name"), ["c1/click", "c2"])).select("entry_idx", "name")


@query("p02_multimodal_filter", "SELECT conv_id, turn, role || '/' || 'language' AS channel FROM conversations WHERE role = 'user'")
def p02(spark, d):
    rows = table(spark, d, "conversations").withColumn("channel", F.concat_ws("/", "role", F.lit("language")))
    return P.modality_steps(rows, "user", "language").select("conv_id", "turn", "channel")


@query("p05_prefix_listing", f"WITH {BL} SELECT entry_idx, name FROM bl WHERE name = 'signal/c1' OR starts_with(name, 'signal/c1/')")
def p05(spark, d):
    return blocks(spark, d).where(N.under_prefix(F.col("name"), "signal/c1")).select("entry_idx", "name")


@query("p06_a13_children", f"WITH {BL} SELECT split_part(substr(name, 8), '/', 1) AS child, min(entry_idx) AS first_entry FROM bl WHERE starts_with(name, 'signal/') GROUP BY 1")
def p06(spark, d):
    return C.children(blocks(spark, d), "signal")


@query("p07_tags", "SELECT event_id, list_contains(['a' || (event_id % 3), 'b' || (event_id % 5)], 'b2') AS has FROM events WHERE list_contains(['a' || (event_id % 3), 'b' || (event_id % 5)], 'b2')")
def p07(spark, d):
    tag = lambda p, n: F.concat(F.lit(p), (F.col("event_id") % n).cast("string"))
    rows = table(spark, d, "events").select("event_id", F.array(tag("a", 3), tag("b", 5)).alias("tags"))
    return P.with_tag(rows, "b2").select("event_id", F.lit(True).alias("has"))


@query("p08_p09_tag_bits", f"WITH {BL} SELECT entry_idx, reserved & 65535 AS content_type, (reserved >> 16) & 65535 AS tag_bits FROM bl WHERE ((reserved >> 16) & 4) <> 0")
def p08(spark, d):
    rows = blocks(spark, d)
    bit = C.tag_position(["train", "test", "gold"], "gold")
    return rows.where(N.has_tag_bit(F.col("reserved"), bit)).select("entry_idx", N.content_type(F.col("reserved")).alias("content_type"), N.tag_bits(F.col("reserved")).alias("tag_bits"))


@query("p10_lookup", f"WITH {BL} SELECT name, min(entry_idx) AS entry_idx FROM bl GROUP BY 1")
def p10(spark, d):
    return C.first_by_name(blocks(spark, d)).select("name", "entry_idx")


@query("p12_lanes", f"WITH {BL} SELECT split_part(name, '/', 1) AS lane, regexp_extract(name, '^[^/]*/(.*)$', 1) AS channel, count(*) AS n FROM bl GROUP BY ALL")
def p12(spark, d):
    return blocks(spark, d).groupBy(N.lane_of(F.col("name")).alias("lane"), N.channel_of(F.col("name")).alias("channel")).agg(F.count("*").alias("n"))


@query("a07_modality_groups", f"WITH {BL}, c AS (SELECT DISTINCT regexp_extract(name, '^[^/]*/(.*)$', 1) AS channel FROM bl) SELECT CASE WHEN contains(channel, '/') THEN split_part(channel, '/', 1) ELSE 'default' END AS grp, string_agg(channel || ':rgb', ',' ORDER BY channel || ':rgb') AS members FROM c GROUP BY 1")
def a07(spark, d):
    channels = blocks(spark, d).select(N.channel_of(F.col("name")).alias("channel")).distinct().withColumn("modality", F.lit("rgb"))
    return C.modality_groups(channels)


TENSORS = "tn AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'embed_tokens' WHEN 1 THEN 'layers.' || (p_partkey % 11) || '.w' WHEN 2 THEN 'blocks.' || (p_partkey % 3) || '.k' ELSE 'lm_head' END AS name, CASE WHEN p_size % 2 = 0 THEN 'f32' ELSE 'f16' END AS dtype, p_size AS d0 FROM part)"
REGION = "CASE WHEN starts_with(name, 'embed') THEN 0 WHEN regexp_extract(name, '(?:layers|blocks)\\.(\\d+)', 1) <> '' THEN regexp_extract(name, '(?:layers|blocks)\\.(\\d+)', 1)::INT + 1 WHEN name = 'lm_head' THEN 65535 ELSE 0 END"


def _tensors(spark, d):
    p = F.col("p_partkey")
    name = F.when(p % 4 == 0, "embed_tokens").when(p % 4 == 1, F.concat(F.lit("layers."), (p % 11).cast("string"), F.lit(".w"))).when(p % 4 == 2, F.concat(F.lit("blocks."), (p % 3).cast("string"), F.lit(".k"))).otherwise("lm_head")
    return table(spark, d, "part").select("p_partkey", name.alias("name"), F.when(F.col("p_size") % 2 == 0, "f32").otherwise("f16").alias("dtype"), F.array(F.col("p_size").cast("bigint")).alias("shape"))


@query("a08_region_groups", f"WITH {TENSORS}, r AS (SELECT DISTINCT name, {REGION} AS region FROM tn) SELECT region, string_agg(name, ',' ORDER BY name) AS tensors, CASE region WHEN 0 THEN 'embeddings' WHEN 65535 THEN 'output' ELSE 'layer_' || (region - 1) END AS label FROM r GROUP BY region")
def a08(spark, d):
    return C.region_groups(_tensors(spark, d).select("name").distinct())


@query("j05_schema_errors", f"""WITH {TENSORS} SELECT name AS tensor_name, 'dtype f32 wanted, is ' || dtype AS message FROM tn WHERE (name LIKE 'layers.%.w' OR name LIKE 'embed%') AND dtype <> 'f32'
UNION ALL SELECT name, 'dimension 0 of 8 wanted' FROM tn WHERE name LIKE 'embed%' AND d0 <> 8 UNION ALL SELECT name, 'rank 2 wanted, is 1' FROM tn WHERE name LIKE 'blocks.%.k' UNION ALL SELECT 'norm.weight', 'required tensor is missing'""")
def j05(spark, d):
    specs = [("layers.*.w", "f32", [-1], False), ("blocks.**.k", None, [-1, -1], True), ("embed**", "f32", [8], False), ("norm.weight", None, None, False), ("*", None, None, True)]
    return C.schema_errors(_tensors(spark, d), specs)


@query("a09_block_summary", f"WITH {BL} SELECT count(*) AS n_blocks, count(*) FILTER (disk_size < orig_size) AS n_compressed, sum(orig_size)::BIGINT AS orig_size, sum(disk_size)::BIGINT AS disk_size, round(sum(orig_size) / sum(disk_size), 9) AS ratio FROM bl")
def a09(spark, d):
    return C.block_summary(blocks(spark, d)).withColumn("ratio", F.round("ratio", 9))


@query("a14_schema_id", "SELECT substr(sha256('train' || chr(0) || 'test' || chr(0) || string_agg(r_name || chr(0) || 'text' || chr(0) || 'name', chr(0) ORDER BY r_name)), 1, 16) AS schema_id FROM region")
def a14(spark, d):
    return C.schema_id(table(spark, d, "region").select(F.col("r_name").alias("name"), F.lit("text").alias("content_type"), F.lit("name").alias("semantic_type")), ["train", "test"])


@query("v01_episode_errors", f"""WITH {LI}, e AS (SELECT episode_id, count(*) AS n, CASE WHEN episode_id % 6 = 0 THEN 0 ELSE count(*) + (episode_id % 9 = 0)::INT END AS length_t FROM li GROUP BY 1),
c AS (SELECT *, CASE WHEN episode_id % 4 = 0 THEN 2 END AS ci FROM e)
SELECT episode_id, 'length' AS rule FROM c WHERE length_t <= 0 UNION ALL SELECT episode_id, 'chunk_index' FROM c WHERE ci IS NOT NULL
UNION ALL SELECT episode_id, 'chunk_range' FROM c WHERE ci IS NOT NULL AND 5 > length_t UNION ALL SELECT episode_id, 'channel_length:v' FROM c WHERE n <> length_t""")
def v01(spark, d):
    true = E.lengths(item_steps(spark, d)).select("episode_id", F.col("n_steps").alias("n"))
    stated = F.when(F.col("episode_id") % 6 == 0, 0).otherwise(F.col("n") + (F.col("episode_id") % 9 == 0).cast("int"))
    part = F.col("episode_id") % 4 == 0
    episodes = true.select("episode_id", stated.alias("length_t")).select("*", F.when(part, 2).alias("chunk_index"), F.when(part, 2).alias("total_chunks"), F.when(part, 5).alias("t_start"), F.when(part, F.col("length_t")).alias("t_end"))
    return C.episode_errors(episodes, true.withColumn("channel", F.lit("v")))


@query("v02_writer_errors", f"WITH {BL}, g AS (SELECT entry_idx % 50 AS episode_id, bool_or(starts_with(name, 'action/')) AS a, bool_or(starts_with(name, 'signal/')) AS s FROM bl GROUP BY 1) SELECT episode_id, 'time' AS rule FROM g UNION ALL SELECT episode_id, 'done' FROM g UNION ALL SELECT episode_id, 'action' FROM g WHERE NOT a UNION ALL SELECT episode_id, 'signal' FROM g WHERE NOT s")
def v02(spark, d):
    return C.writer_errors(blocks(spark, d).withColumn("episode_id", F.col("entry_idx") % 50))


@query("v04_step_errors", f"WITH {EV} SELECT episode_id, t, CASE WHEN event_type NOT IN ('click', 'view') THEN 'channel' WHEN event_type = 'view' THEN 'shape' ELSE 'max_timesteps' END AS rule FROM ev WHERE event_type NOT IN ('click', 'view') OR event_type = 'view' OR t >= 40")
def v04(spark, d):
    steps = event_steps(spark, d).withColumn("channel", F.col("event_type")).withColumn("value", F.array("x"))
    return C.step_errors(steps, {"click": 1, "view": 2}, 40).select("episode_id", "t", "rule")


@query("v08_known_modality", "SELECT event_type, CASE WHEN event_type IN ('rgb', 'depth', 'language', 'proprioception', 'audio', 'video', 'pointcloud') THEN event_type END AS modality, count(*) AS n FROM events GROUP BY ALL")
def v08(spark, d):
    return table(spark, d, "events").groupBy("event_type", P.known_modality(F.col("event_type")).alias("modality")).agg(F.count("*").alias("n"))


@query("u01_unlisted_blocks", f"WITH {BL}, l AS (SELECT DISTINCT name FROM bl WHERE entry_idx % 4 = 0) SELECT entry_idx, name, true AS listed FROM bl WHERE name IN (SELECT name FROM l) UNION ALL SELECT entry_idx, name, false FROM bl WHERE (starts_with(name, 'signal/') OR starts_with(name, 'action/')) AND name NOT IN (SELECT name FROM l)")
def u01(spark, d):
    rows = blocks(spark, d).select("entry_idx", "name")
    return C.unlisted(rows, rows.where("entry_idx % 4 = 0")).select("entry_idx", "name", "listed")


@query("f_str1_f_str2_paths", "SELECT page_id, len(list_filter(string_split(url, '/'), lambda x: x <> '')) AS n_parts, regexp_extract(url, '^(.*)/[^/]*$', 1) AS parent, regexp_extract(url, '([^/]*)$', 1) AS base FROM pages")
def f_str1(spark, d):
    url = F.col("url")
    return table(spark, d, "pages").select("page_id", F.size(N.split_path(url)).cast("bigint").alias("n_parts"), N.path_parent(url).alias("parent"), N.path_base(url).alias("base"))


@query("f_str4_block_names", "SELECT event_id, 'omen/c' || (user_id % 3) || '/dreamer' AS omen, 'uncert/c' || (user_id % 3) || '/dreamer/variance' AS uncert, 'signal/c' || (user_id % 3) AS signal FROM events")
def f_str4(spark, d):
    c = F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string"))
    return table(spark, d, "events").select("event_id", N.block_name("omen", c, F.lit("dreamer")).alias("omen"), N.block_name("uncert", c, F.lit("dreamer"), F.lit("variance")).alias("uncert"), N.block_name("signal", F.concat(F.lit("signal/"), c)).alias("signal"))


@query("f_str5_globs", f"WITH {TENSORS} SELECT p_partkey, name LIKE 'layers.%.w' AS star, starts_with(name, 'blocks') AND ends_with(name, 'k') AS deep FROM tn")
def f_str5(spark, d):
    n = F.col("name")
    return _tensors(spark, d).select("p_partkey", N.matches_glob(n, "layers.*.w").alias("star"), N.matches_glob(n, "blocks.**.k").alias("deep"))


@query("f_str6_r01_mangled_names", f"WITH {BL} SELECT entry_idx, replace(name, '/', '_') AS flat FROM bl")
def f_str6(spark, d):
    return blocks(spark, d).select("entry_idx", P.flat_name(F.col("name")).alias("flat"))


@query("f_dt1_ticks_to_ns", "SELECT p_partkey, trunc(1e9 / p_size)::BIGINT AS cut, round(1e9 / p_size)::BIGINT AS rounded FROM part")
def f_dt1(spark, d):
    return table(spark, d, "part").select("p_partkey", N.tick_to_ns(F.col("p_size")).alias("cut"), N.tick_to_ns(F.col("p_size"), rounded=True).alias("rounded"))


@query("f_math2_f_math3_sizes", "SELECT p_partkey, ((p_size + 31) // 32 * 32)::BIGINT AS aligned, CASE WHEN p_partkey % 2 = 0 THEN -1 ELSE p_size::BIGINT * 100 END AS elements FROM part")
def f_math(spark, d):
    big = F.when(F.col("p_partkey") % 2 == 0, F.lit(1 << 62)).otherwise(F.lit(100).cast("bigint"))
    size = F.col("p_size").cast("bigint")
    return table(spark, d, "part").select("p_partkey", N.align_up(size, 32).alias("aligned"), N.element_count(F.array(size + F.when(F.col("p_partkey") % 2 == 0, 4).otherwise(0), big)).alias("elements"))


@query("c02_c03_codecs", f"WITH {BL} SELECT entry_idx, CASE WHEN flags & 1 = 0 THEN 'none' WHEN flags & 4 <> 0 THEN 'lz4' WHEN flags & 2 <> 0 THEN 'zstd' ELSE ['none', 'zstd', 'lz4'][default_codec + 1] END AS codec, orig_size >= 64 AND disk_size < orig_size AS keep FROM bl")
def c02(spark, d):
    return blocks(spark, d).select("entry_idx", N.codec_of(F.col("flags"), F.col("default_codec")).alias("codec"), N.worth_compressing(F.col("orig_size"), F.col("disk_size")).alias("keep"))


@query("f_typ1_dtypes", "SELECT event_id, ['f32', 'bf16', 'u8', 'qint4', NULL][event_id % 5 + 1] AS dtype, [32, 16, 8, 4, NULL][event_id % 5 + 1] AS bits FROM events")
def f_typ1(spark, d):
    raw = F.element_at(F.array(*[F.lit(x) for x in ("Float32", "bfloat16", "uint8", "qint4", "wide")]), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", N.dtype_name(raw).alias("dtype"), N.dtype_bits(raw).alias("bits"))


@query("f_json1_metadata", "SELECT event_id, coalesce(json_extract_string(props, '$.episode_id'), json_extract_string(props, '$.id'), event_id::VARCHAR) AS id FROM events")
def f_json1(spark, d):
    return table(spark, d, "events").select("event_id", F.coalesce(P.metadata_value(F.col("props"), "episode_id", "id"), F.col("event_id").cast("string")).alias("id"))


@query("s16_formats", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'npz' WHEN 1 THEN 'container' WHEN 2 THEN 'parquet' ELSE 'unknown' END AS format FROM pages")
def s16(spark, d):
    p = F.col("page_id") % 4
    rows = table(spark, d, "pages").select("page_id", F.when(p == 0, "a.NPZ").otherwise("a.bin").alias("path"), F.when(p == 1, F.lit(b"SHRD..")).when(p == 2, F.lit(b"PAR1..")).otherwise(F.lit(b"????")).alias("head"))
    return rows.select("page_id", N.format_of(F.col("path"), F.col("head")).alias("format"))


@query("s11_lane_getter", f"WITH {OM} SELECT episode_id, t, round(omen, 7) AS value FROM om WHERE t >= 1")
def s11(spark, d):
    return P.lane_steps(_lanes(spark, d), "omen", "x", "ma3").where("t >= 1").select("episode_id", "t", F.round("value", 7).alias("value"))


@query("p03_r02_latent_action", f"WITH {EV} SELECT episode_id, t, 'omen/latent_action_codebook/genie' AS name, (event_id % 256)::INT AS code FROM ev")
def p03(spark, d):
    steps = event_steps(spark, d).withColumn("code", (F.col("event_id") % 256).cast("int"))
    return P.latent_actions(steps, "code", "genie")


@query("o01_o06_sorted_names", f"WITH {BL} SELECT DISTINCT name FROM bl ORDER BY name LIMIT 20")
def o01(spark, d):
    return P.sorted_names(blocks(spark, d), 20)


@query("t08_time_windows", "SELECT epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS start_s, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def t08(spark, d):
    w = F.window("ts", "1 hour")
    return table(spark, d, "events").groupBy(w.alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.unix_timestamp("w.start").alias("start_s"), "n", "total")


@query("t10_sessions", "WITH s AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS g FROM s) SELECT user_id, (epoch_us(min(ts)) // 1000000)::BIGINT AS start_s, count(*) AS n FROM g GROUP BY user_id, g")
def t10(spark, d):
    return table(spark, d, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.unix_timestamp("w.start").alias("start_s"), "n")


def _containers(spark, d, codec="zstd"):
    """A folder of written container files, one for each episode."""
    from ..sources.container import pack_episodes
    from ..sources.files import scratch_folder, write_files

    steps = predicted_steps(spark, d).withColumn("done", F.col("terminated").cast("int"))
    files = pack_episodes(steps, {"signal/x": ("x", "f64"), "omen/x/ma3": ("omen", "f64"), "reward": ("x", "f64"), "done": ("done", "u8")}, codec=codec)
    folder = scratch_folder(spark, "containers")
    write_files(files, folder)
    return folder


def _file():
    return F.substring_index("file", "/", -1).alias("file")


@query("s01_k01_container_round_trip", f"WITH {OM} SELECT episode_id || '.bin' AS file, t, 'omen/x/ma3' AS name, round(omen, 9) AS value FROM om UNION ALL SELECT episode_id || '.bin', t, 'signal/x', round(x, 9) FROM om UNION ALL SELECT episode_id || '.bin', t, 'done', terminated::INT::DOUBLE FROM om")
def s01(spark, d):
    from ..sources.container import decode_steps, read_blocks

    blocks_ = read_blocks(spark, _containers(spark, d)).where("name <> 'reward'")
    return decode_steps(blocks_).select(_file(), "t", "name", F.round(F.get("value", F.lit(0)), 9).alias("value"))


@query("s02_projected_load", f"WITH {EV} SELECT episode_id || '.bin' AS file, t, round(x, 9) AS value FROM ev")
def s02(spark, d):
    from ..sources.container import decode_steps, read_blocks

    some = read_blocks(spark, _containers(spark, d), names=["meta/channels", "signal/x"])
    return decode_steps(some).select(_file(), "t", F.round(F.get("value", F.lit(0)), 9).alias("value"))


@query("s05_s22_container_catalog", f"WITH {EV}, n AS (SELECT episode_id || '.bin' AS file, count(*) AS n FROM ev GROUP BY 1) SELECT file, 'signal/x' AS name, n * 8 AS orig_size FROM n UNION ALL SELECT file, 'omen/x/ma3', n * 8 FROM n UNION ALL SELECT file, 'done', n FROM n UNION ALL SELECT file, 'time/ticks', n * 4 FROM n")
def s05(spark, d):
    from ..sources.container import read_blocks

    return read_blocks(spark, _containers(spark, d), payload=False, verify=False).where("lane <> 'meta' and name <> 'reward'").select(_file(), "name", "orig_size")


@query("s07_prefix_read", f"WITH {EV} SELECT DISTINCT episode_id || '.bin' AS file, 16 AS n FROM ev")
def s07(spark, d):
    from ..sources.container import read_blocks

    return read_blocks(spark, _containers(spark, d), names=["signal/x"], first_bytes=16).select(_file(), F.octet_length("payload").alias("n"))


@query("a10_v06_v07_verify", f"WITH {EV} SELECT episode_id || '.bin' AS file, 7 AS checked, 0 AS failures, 0 AS hash_failures FROM ev GROUP BY 1")
def a10(spark, d):
    from ..sources.container import read_blocks, verify_blocks

    return verify_blocks(read_blocks(spark, _containers(spark, d), payload=False)).withColumn("file", _file())


@query("f_arr1_f_arr2_tensor_bytes", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS s, len(embedding) * 4 AS n_bytes FROM embeddings")
def f_arr12(spark, d):
    from ..functions.binary import decoded, encoded

    rows = table(spark, d, "embeddings").select("vec_id", encoded(F.col("embedding"), "f32").alias("b"))
    return rows.select("vec_id", F.round(F.aggregate(decoded(F.col("b"), "f32"), F.lit(0.0), lambda a, x: a + x), 6).alias("s"), F.octet_length("b").cast("bigint").alias("n_bytes"))


@query("f_bin1_f_bin2_checksums")
def f_bin12(spark, d):
    from ..functions.binary import crc32c_of, xxh64_of

    return table(spark, d, "documents").select("doc_id", crc32c_of(F.col("text").cast("binary")).alias("crc32c"), xxh64_of(F.col("text")).alias("xxh64"))


@query("f_str8_type_names", "SELECT event_id, CASE event_id % 20 WHEN 1 THEN 'tensor' WHEN 2 THEN 'json' WHEN 5 THEN 'text' WHEN 6 THEN 'image' WHEN 7 THEN 'audio' WHEN 8 THEN 'video' WHEN 9 THEN 'proto' WHEN 10 THEN 'blob' WHEN 12 THEN 'tensor_v3' WHEN 13 THEN 'anchor_shared' WHEN 14 THEN 'delta_expert' WHEN 15 THEN 'codebook_shared' WHEN 16 THEN 'expert_indices' WHEN 17 THEN 'column' ELSE CASE WHEN event_id % 20 = 19 THEN 'user:7' ELSE 'unknown' END END AS content_type, CASE WHEN event_id % 9 IN (0, 7) THEN 'unknown:' || (event_id % 9) ELSE ['model', 'sample', 'panel', 'manifest', 'episode', 'universal_model', '', 'column'][event_id % 9] END AS role FROM events")
def f_str8(spark, d):
    n = F.col("event_id") % 20
    number = F.when(n == 19, N.USER_TYPES + 7).otherwise(n)
    return table(spark, d, "events").select("event_id", N.content_type_name(number).alias("content_type"), N.role_name(F.col("event_id") % 9).alias("role"))


@query("f_str10_file_names", "SELECT page_id, 'p' || page_id AS stem, CASE WHEN page_id % 2 = 0 THEN 'u' || page_id ELSE 'p' || page_id END AS episode FROM pages")
def f_str10(spark, d):
    p = F.col("page_id").cast("string")
    rows = table(spark, d, "pages").select("page_id", F.concat(F.lit("a/b.c/p"), p, F.lit(".npz")).alias("path"), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("x/2020-u"), p, F.lit("-a-b.npz"))).otherwise(F.concat(F.lit("x/p"), p, F.lit(".npz"))).alias("file"))
    return rows.select("page_id", N.file_stem(F.col("path")).alias("stem"), N.episode_of_file(F.col("file")).alias("episode"))


@query("f_dt2_timebase", "SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN 60.0::DOUBLE END, CASE WHEN event_id % 2 = 0 THEN 20.0::DOUBLE END, 30.0::DOUBLE) AS tick_hz FROM events")
def f_dt2(spark, d):
    own, file = F.when(F.col("event_id") % 3 == 0, 60.0), F.when(F.col("event_id") % 2 == 0, 20.0)
    return table(spark, d, "events").select("event_id", P.tick_rate(own, file).alias("tick_hz"))


@query("j09_name_map", f"WITH {TENSORS}, u AS (SELECT DISTINCT name FROM tn), m AS (SELECT name AS canon, 'src.' || name AS source FROM u WHERE name LIKE 'layers%'), x AS (SELECT name FROM u UNION ALL SELECT source FROM m) SELECT x.name, a.source AS source_name, b.canon AS canon_name FROM x LEFT JOIN m a ON a.canon = x.name LEFT JOIN m b ON b.source = x.name")
def j09(spark, d):
    names = _tensors(spark, d).select("name").distinct()
    pairs = names.where("name like 'layers%'").select(F.col("name").alias("canon"), F.concat(F.lit("src."), "name").alias("source"))
    return C.map_names(names.unionByName(pairs.select(F.col("source").alias("name"))), pairs)


@query("j10_o07_block_channels", f"WITH {BL}, u AS (SELECT DISTINCT name FROM bl) SELECT name, CASE WHEN name = 'signal/c1/click' THEN 'f32' WHEN name = 'action/c2/view' THEN 'u8' END AS dtype FROM u ORDER BY name DESC")
def j10(spark, d):
    channels = spark.createDataFrame([("c1/click", "f32"), ("action/c2/view", "u8")], "id string, dtype string")
    return C.join_channels(blocks(spark, d).select("name").distinct(), channels).orderBy(F.desc("name"))


@query("s21_file_listing", "SELECT 'd/' || page_id || '.bin' AS path FROM pages WHERE page_id::VARCHAR IN ('1', '3', '5', '7') ORDER BY path LIMIT 3")
def s21(spark, d):
    files = table(spark, d, "pages").select(F.concat(F.lit("d/"), F.col("page_id").cast("string"), F.lit(".bin")).alias("path"))
    return C.list_files(files, ["1", "3", "5", "7"], 3)


@query("x01_embedder", f"WITH {LI}, u AS (SELECT episode_id, unnest(range(4)) AS dim, unnest(v) AS x FROM li) SELECT episode_id, dim, round(2 * avg(x) + 1, 7) AS m FROM u GROUP BY ALL")
def x01(spark, d):
    pooled = E.embed(E.mean_pool(item_steps(spark, d), "v"), lambda v: 2 * v + 1)
    return pooled.select("episode_id", F.posexplode("embedding").alias("dim", "m")).withColumn("m", F.round("m", 7))


@query("f_json3_tags", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'gold,new' ELSE 'gold' END AS tags FROM events")
def f_json3(spark, d):
    tags = F.when(F.col("event_id") % 2 == 0, F.array(F.lit("gold"), F.lit("new"))).otherwise(F.array(F.lit("gold")))
    again = F.when(F.col("event_id") % 2 == 0, C.add_tag(F.col("t"), "new")).otherwise(C.add_tag(F.col("t"), "gold"))
    return table(spark, d, "events").select("event_id", tags.alias("t")).select("event_id", F.array_join(again, ",").alias("tags"))


@query("s15_k07_npz_round_trip", f"WITH {EV} SELECT episode_id || '' AS episode_id, t, round(x, 9) AS reward, coalesce(lag(terminated OR truncated) OVER w, true) AS is_first, terminated OR truncated OR lead(1) OVER w IS NULL AS is_last FROM ev WINDOW w AS (PARTITION BY episode_id ORDER BY t)")
def s15(spark, d):
    from ..sources.files import scratch_folder, write_files
    from ..sources.npz import pack_npz, read_npz

    folder = scratch_folder(spark, "replay")
    write_files(pack_npz(event_steps(spark, d), {"reward": "x"}), folder)
    return read_npz(spark, folder).where("lane = 'reward'").select("episode_id", "t", F.round(F.get("value", F.lit(0)), 9).alias("reward"), "is_first", "is_last")


@query("cli1_inspect", f"WITH {EV} SELECT episode_id || '.bin' AS file, 5 AS n_blocks, sum(8 * 3 + 1 + 4)::BIGINT AS orig_size FROM ev GROUP BY episode_id")
def cli1(spark, d):
    from ..sources.container import inspect, read_blocks

    return inspect(read_blocks(spark, _containers(spark, d), payload=False, verify=False).where("lane <> 'meta'")).select(_file(), "n_blocks", "orig_size")


def _converted(spark, d, *formats):
    """Steps of two lanes saved as the first format and converted to each next one; the last one's folder."""
    from ..sources import dispatch
    from ..sources.files import scratch_folder

    rows = _lanes(spark, d).where("lane = 'signal'").select(F.col("episode_id").cast("string").alias("episode_id"), "lane", "channel", "t", F.array("value").alias("value"))
    folder = scratch_folder(spark, formats[0])
    dispatch.save(rows, folder, formats[0])
    for to in formats[1:]:
        target = scratch_folder(spark, to)
        dispatch.convert(spark, folder, target, to)
        folder = target
    return folder


@query("s17_k08_convert", f"WITH {EV} SELECT episode_id::VARCHAR AS episode_id, 'signal' AS lane, 'x' AS channel, t, round(x, 9) AS value FROM ev")
def s17(spark, d):
    from ..sources import dispatch

    rows = dispatch.load(spark, _converted(spark, d, "parquet", "container"))
    return rows.select("episode_id", "lane", "channel", "t", F.round(F.get("value", F.lit(0)), 9).alias("value"))


@query("cli3_cli4_convert_export", f"WITH {EV} SELECT episode_id::VARCHAR AS episode_id, t, round(x, 9) AS value FROM ev")
def cli34(spark, d):
    from ..__main__ import main
    from ..sources import dispatch
    from ..sources.files import scratch_folder

    folder, target, exported = _converted(spark, d, "parquet"), scratch_folder(spark, "cli"), scratch_folder(spark, "export")
    if main(["convert", folder, target, "--to", "container"]) or main(["export", target, exported]):
        raise ValueError("the command line failed")
    return dispatch.load(spark, exported, "parquet").select("episode_id", "t", F.round(F.get("value", F.lit(0)), 9).alias("value"))


@query("f_math4_checked_int", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey::INT END AS narrow, o_orderkey::BIGINT AS wide FROM orders")
def f_math4(spark, d):
    key = F.col("o_orderkey").cast("decimal(20,0)")
    large = key + F.when(F.col("o_orderkey") % 3 == 0, F.lit(1 << 33)).otherwise(0)
    return table(spark, d, "orders").select("o_orderkey", P.checked_int(large.cast("decimal(20,0)")).alias("narrow"), P.checked_int(key, 64).alias("wide"))


@query("x03_map_chunks", f"WITH {EV} SELECT episode_id, t // 64 AS chunk_index, count(*) AS n, round(sum(x), 4) AS total FROM ev GROUP BY ALL")
def x03(spark, d):
    def total(key, frame):
        import pandas as pd

        return pd.DataFrame({"episode_id": [key[0]], "chunk_index": [key[1]], "n": [len(frame)], "total": [float(frame["x"].sum())]})

    return K.map_chunks(event_steps(spark, d).select("episode_id", "t", "x"), 64, total, "episode_id bigint, chunk_index bigint, n bigint, total double").withColumn("total", F.round("total", 4))


@query("p11_r07_entries", f"WITH {BL}, n AS (SELECT DISTINCT 'signal/c' || (user_id % 9) || '/click' AS name FROM events), g AS (SELECT name, count(*) AS n_entries, arg_min(orig_size, entry_idx) AS size FROM bl GROUP BY 1) SELECT name, coalesce(n_entries, 0) AS n_entries, size, n_entries IS NOT NULL AS has FROM n LEFT JOIN g USING (name)")
def p11(spark, d):
    names = table(spark, d, "events").select(F.concat(F.lit("signal/c"), (F.col("user_id") % 9).cast("string"), F.lit("/click")).alias("name")).distinct()
    return P.has_entry(blocks(spark, d), names)


@query("r07_entry_flags", f"WITH {BL} SELECT entry_idx, flags & 1 <> 0 AS compressed, flags & 8 <> 0 AS chunked FROM bl")
def r07(spark, d):
    return blocks(spark, d).select("entry_idx", P.is_compressed(F.col("flags")).alias("compressed"), P.is_chunked(F.col("flags")).alias("chunked"))


@query("p11_channel_definitions", f"WITH {EV} SELECT DISTINCT episode_id || '.bin' AS file, unnest(['x', 'x/ma3']) AS id, 'f64' AS dtype, 1 AS width, NULL::VARCHAR AS modality, unnest(['signal/x', 'omen/x/ma3']) AS signal_block FROM ev")
def p11b(spark, d):
    from ..sources.container import read_blocks

    texts = read_blocks(spark, _containers(spark, d), names=["meta/channels"]).select(_file(), F.col("payload").cast("string").alias("metadata"))
    return P.channel_definitions(texts).select("file", "id", "dtype", F.get("shape", F.lit(0)).alias("width"), "modality", "signal_block")


@query("r01_add_observation", f"WITH {EV} SELECT episode_id, 'signal' AS lane, 'x' AS channel, t, round(x, 7) AS value FROM ev UNION ALL SELECT episode_id, 'signal', 'arm/depth', t, t * 1.0::DOUBLE FROM ev")
def r01(spark, d):
    steps = P.lane_steps(_lanes(spark, d), "signal")
    more = steps.select("episode_id", "t", F.col("t").cast("double").alias("value"))
    return P.add_observation(steps, more, "arm", "depth").select("episode_id", "lane", "channel", "t", F.round("value", 7).alias("value"))


@query("schema_registry", f"WITH {TENSORS}, e AS (SELECT name, CASE WHEN name LIKE 'layers.%' THEN 'layers' WHEN name LIKE 'blocks.%' THEN 'blocks' END AS spec FROM tn) SELECT name, spec, count(*) AS n FROM e GROUP BY ALL")
def schema_registry(spark, d):
    schema = S.Schema("test").tensor("layers.**").tensor("blocks.**", shape=[-1, 4])
    again = S.Schema.decode(schema.encode())
    label = F.when(F.col("spec") == 0, "layers").when(F.col("spec") == 1, "blocks")
    return C.match_specs(_tensors(spark, d), again.rules()).groupBy("name", label.alias("spec")).agg(F.count("*").alias("n"))


@query("quantised_tensors", "SELECT p_partkey::VARCHAR AS tensor, 'int4' AS scheme, p_size AS group_size, 'f16' AS orig_dtype, unnest(['scale', 'zero']) AS role, unnest(['s' || p_partkey, 'z' || p_partkey]) AS aux_tensor, unnest([true, p_partkey % 2 = 0]) AS present FROM part")
def quantised(spark, d):
    key = F.col("p_partkey").cast("string")
    parts = table(spark, d, "part")
    aux = F.array(F.struct(F.lit("scale").alias("role"), F.concat(F.lit("s"), key).alias("name")), F.struct(F.lit("zero").alias("role"), F.concat(F.lit("z"), key).alias("name")))
    records = parts.select(key.alias("tensor"), F.lit("int4").alias("scheme"), F.col("p_size").alias("group_size"), F.lit("f16").alias("orig_dtype"), aux.alias("aux"))
    there = parts.select(F.explode(F.array(F.concat(F.lit("s"), key), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("z"), key)))).alias("name")).where("name is not null")
    return S.quantised_tensors(records, there)


@query("t01_t06_record_containers", f"WITH {EV} SELECT episode_id::VARCHAR AS episode_id, channel, t, round(v, 9) AS value FROM (SELECT episode_id, 'signal' AS lane, 'x' AS channel, t, x AS v FROM ev UNION ALL SELECT episode_id, 'reward', 'reward', t, x FROM ev UNION ALL SELECT episode_id, 'done', 'done', t, (t = max(t) OVER (PARTITION BY episode_id))::INT FROM ev) WHERE episode_id % 10 <> 3")
def t01(spark, d):
    """Events recorded from a stream of files to containers; every tenth episode is aborted."""
    from pyspark.sql import Window

    from ..sources import dispatch
    from ..sources.files import scratch_folder
    from ..streaming import recorder as T

    source, out, check = (scratch_folder(spark, x) for x in ("steps", "recorded", "stream"))
    steps = event_steps(spark, d).withColumn("end", F.col("t") == F.max("t").over(Window.partitionBy("episode_id")))
    aborted = F.col("end") & (F.col("episode_id") % 10 == 3)
    rows = steps.select(F.col("episode_id").cast("string").alias("episode_id"), "t", F.when(aborted, T.ABORT).otherwise("x").alias("channel"), F.array("x").alias("value"), F.col("x").alias("reward"), (F.col("end") & ~aborted).alias("done"), F.col("ts").cast("timestamp").alias("ts"))
    rows.write.parquet(source)
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        good, _ = T.split_valid(T.read_steps(spark, source), {"x": 1})
        T.write_containers(T.record(good), out, check).awaitTermination()
    finally:
        spark.conf.set(store, before)
    return dispatch.load(spark, out).select("episode_id", "channel", "t", F.round(F.get("value", F.lit(0)), 9).alias("value"))
