"""Queries of variograms, trends, kriging, stacking and confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.functions import rules
from strataflow.operators import geostat, surfaces
from strataflow.plans.space import _POINTS, points
from strataflow.registry import query

_LAGS = f"""with p as ({_POINTS}), d as (select a.label, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) as d, 0.5 * (a.z - b.z) ** 2 as g from p a join p b on a.label = b.label and a.vec_id < b.vec_id),
    m as (select label, max(d) / 2 as most from d group by 1), v as (select label, least(floor(d / (most / 12)), 11)::int as bin, avg(d) as lag, avg(g) as gamma, count(*) as n from d join m using (label) where d > 0 and d <= most group by 1, 2 having count(*) >= 3)"""


@query(f"{_LAGS} select label, bin, round(lag, 6) as lag, round(gamma, 8) as gamma, n from v", "embeddings")
def variogram_lags(embeddings: DataFrame) -> DataFrame:
    """Semivariances of pairs by distance."""
    return geostat.lags(points(embeddings), "label", "vec_id", "x", "y", "z").select("label", "bin", F.round("lag", 6).alias("lag"), F.round("gamma", 8).alias("gamma"), "n")


@query(
    f"""{_LAGS}, e as (select label, min(lag) * 0.5 as lo, max(lag) * 3.0 as hi, sum(n * gamma) / sum(n) as mean from v group by 1 having count(*) >= 3),
    t as (select label, mean, lo * pow(hi / lo, i / 59.0::double) as a from e, range(60) as r(i)),
    f as (select label, mean, a, 'spherical' as kind, n, gamma, case when lag / a >= 1 then 1.0 else 1.5 * lag / a - 0.5 * (lag / a) ** 3 end as f from t join v using (label)
      union all select label, mean, a, 'exponential', n, gamma, 1 - exp(-3 * lag / a) from t join v using (label) union all select label, mean, a, 'gaussian', n, gamma, 1 - exp(-3 * (lag / a) ** 2) from t join v using (label)),
    s as (select label, mean, a, kind, sum(n) as w, sum(n * f) as wf, sum(n * f * f) as wff, sum(n * gamma) as wg, sum(n * f * gamma) as wfg, sum(n * gamma * gamma) as wgg from f group by all),
    c as (select *, case when abs(w * wff - wf * wf) > 1e-12 then (wff * wg - wf * wfg) / (w * wff - wf * wf) else -1.0 end as c0, case when abs(w * wff - wf * wf) > 1e-12 then (w * wfg - wf * wg) / (w * wff - wf * wf) else 0.0 end as c1 from s),
    h as (select *, case when c0 < 0 then 0.0 else c0 end as d0, case when c0 < 0 then wfg / wff else c1 end as d1 from c),
    k as (select *, case when d1 < 0 then wg / w else d0 end as e0, case when d1 < 0 then 0.0 else d1 end as e1 from h),
    x as (select *, wgg + e0 * e0 * w + e1 * e1 * wff - 2 * e0 * wg - 2 * e1 * wfg + 2 * e0 * e1 * wf as sse from k)
    select label, round(min(sse), 7) as sse, round(max(1 - sse / (wgg - mean * mean * w)), 5) as r2 from x group by 1""",
    "embeddings",
)
def variogram_fit(embeddings: DataFrame) -> DataFrame:
    """The best variogram of each surface over models and ranges, by weighted least squares."""
    found = geostat.fits(geostat.lags(points(embeddings), "label", "vec_id", "x", "y", "z"), "label")
    return found.select("label", F.round("sse", 7).alias("sse"), F.round("r2", 5).alias("r2"))


@query(
    f"""with p as ({_POINTS}), m as (select label, avg(x) as mx, avg(y) as my, avg(z) as mz, covar_pop(x, x) as xx, covar_pop(y, y) as yy, covar_pop(x, y) as xy, covar_pop(x, z) as xz, covar_pop(y, z) as yz from p group by 1),
    b as (select *, (yy * xz - xy * yz) / (xx * yy - xy * xy) as bx, (xx * yz - xy * xz) / (xx * yy - xy * xy) as bw from m)
    select vec_id, round(z - (mz + bx * (x - mx) + bw * (y - my)), 6) as residual from p join b using (label)""",
    "embeddings",
)
def planar_trend(embeddings: DataFrame) -> DataFrame:
    """Residuals of the least-squares plane of each surface."""
    return surfaces.trend(points(embeddings), "label", "x", "y", "z", "linear").select("vec_id", F.round("residual", 6).alias("residual"))


@query(None, "embeddings")
def kriging_loo(embeddings: DataFrame) -> DataFrame:
    """Kriging of each point from the others of its surface, ordinary and with a planar drift; tests hold it against
    systems solved anew without each point."""
    p = points(embeddings)
    models = geostat.fits(geostat.lags(p, "label", "vec_id", "x", "y", "z"), "label")
    plain, drifted = (geostat.kriging_loo(p, models, "label", "vec_id", "x", "y", "z", d) for d in ("constant", "linear"))
    return plain.select("vec_id", F.round("error", 6).alias("ordinary"), F.round("variance", 6).alias("variance"), "reason").join(drifted.select("vec_id", F.round("error", 6).alias("universal")), "vec_id")


@query(
    f"""with p as ({_POINTS}), i as (select a.vec_id, sum(b.z / ((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) / sum(1 / ((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) as est from p a join p b on a.label = b.label and a.vec_id <> b.vec_id group by 1),
    m as (select label, avg(z) as mz, count(*) as n from p group by 1), e as (select label, sqrt(avg((z - est) ** 2)) as idw, sqrt(avg(((z - mz) * n / (n - 1)) ** 2)) as mean from p join i using (vec_id) join m using (label) group by 1)
    select label, round(idw, 6) as idw, round(mean, 6) as mean, case when mean > 1.1 * idw then 'idw' else 'mean' end as chosen from e""",
    "embeddings",
)
def method_choice(embeddings: DataFrame) -> DataFrame:
    """Methods compared by leave-one-out error; the first choice stays unless it is over a tenth worse."""
    p = points(embeddings)
    idw = p.join(surfaces.idw_loo(p, "vec_id", "label", "x", "y", "z"), "vec_id").groupBy("label").agg(F.sqrt(F.avg(F.pow(F.col("z") - F.col("estimate"), 2))).alias("idw"))
    means = p.groupBy("label").agg(F.avg("z").alias("mz"), F.count("*").alias("n"))
    mean = p.join(means, "label").where("n > 1").groupBy("label").agg(F.sqrt(F.avg(F.pow((F.col("z") - F.col("mz")) * F.col("n") / (F.col("n") - 1), 2))).alias("mean"))
    chosen = F.when(F.col("mean") > 1.1 * F.col("idw"), "idw").otherwise("mean")
    return idw.join(mean, "label").select("label", F.round("idw", 6).alias("idw"), F.round("mean", 6).alias("mean"), chosen.alias("chosen"))


@query(
    f"""with p as ({_POINTS}), i as (select a.vec_id, sum(b.z / ((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) / sum(1 / ((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) as est from p a join p b on a.label = b.label and a.vec_id <> b.vec_id group by 1),
    n as (select a.vec_id, arg_min(b.z, struct_pack(d := (a.x - b.x) ** 2 + (a.y - b.y) ** 2, i := b.vec_id)) as est from p a join p b on a.label = b.label and a.vec_id <> b.vec_id group by 1),
    m as (select label, avg(z) as mz, count(*) as n from p group by 1),
    e as (select label, 'idw' as method, z - est as e from p join i using (vec_id) union all select label, 'nearest', z - est from p join n using (vec_id) union all select label, 'mean', (z - mz) * n / (n - 1) from p join m using (label)),
    t as (select label, method, count(*) as n, sqrt(avg(e * e)) as rmse, avg(abs(e)) as mae, avg(e) as bias from e group by 1, 2),
    w as (select label, case when min(rmse) filter (where method = 'idw') <= 1.1 * min(rmse) then 'idw' else arg_min(method, struct_pack(r := rmse, m := method)) end as winner from t group by 1)
    select label, method, n, round(rmse, 6) as rmse, round(mae, 6) as mae, round(bias, 6) as bias, method = winner as chosen from t join w using (label)""",
    "embeddings",
)
def method_table(embeddings: DataFrame) -> DataFrame:
    """Errors without each point of inverse distances, of the nearest point and of the mean, and which is chosen."""
    p = points(embeddings)
    error = lambda method, estimate: F.struct(F.lit(method).alias("method"), (F.col("z") - F.col(estimate)).alias("e"))
    near = p.join(surfaces.loo(p, "vec_id", "label", "x", "y", "z"), "vec_id").select("label", F.inline(F.array(error("idw", "estimate"), error("nearest", "nearest"))))
    means = p.groupBy("label").agg(F.avg("z").alias("mz"), F.count("*").alias("n"))
    mean = p.join(means, "label").where("n > 1").select("label", F.lit("mean").alias("method"), ((F.col("z") - F.col("mz")) * F.col("n") / (F.col("n") - 1)).alias("e"))
    found = surfaces.method_table(near.union(mean), "label", "method", "e", "idw")
    return found.select("label", "method", "n", *(F.round(c, 6).alias(c) for c in ("rmse", "mae", "bias")), "chosen")


@query(
    """with f as (select user_id, event_type, min(struct_pack(ts := ts, i := event_id)) as t from events group by all)
    select a.event_type as a, b.event_type as b, count(*) as n from f a join f b on a.user_id = b.user_id and a.event_type <> b.event_type and a.t < b.t group by all""",
    "events",
)
def superposition(events: DataFrame) -> DataFrame:
    """In how many holes one kind first appears above another: first appearances, then pairs of them."""
    first = events.groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("t"))
    holes = first.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("t", "event_type"))).alias("o"))  # one entry a kind
    pairs = holes.select(F.posexplode("o").alias("i", "a"), "o").select(F.col("a.event_type").alias("a"), F.explode(F.slice("o", F.col("i") + 2, F.size("o"))).alias("b"))
    return pairs.groupBy("a", F.col("b.event_type").alias("b")).agg(F.count("*").alias("n"))


@query(
    """with u as (select p_brand, p_type, min(p_size)::double as y, min(p_size) + count(*) % 4 + 1.0 as o from part group by all),
    s as (select p_brand, a, b, count(*) as n from (select l.p_brand, l.p_type as a, r.p_type as b from (select p_brand, p_type, p_name, min(p_retailprice) as d from part group by all) l join (select p_brand, p_type, p_name, min(p_retailprice) as d from part group by all) r on l.p_brand = r.p_brand and l.p_name = r.p_name and l.p_type <> r.p_type and l.d < r.d) group by all),
    j as (select p.p_brand, p.p_type as a, q.p_type as b, case when p.o <= q.y then 'a over b' when q.o <= p.y then 'b over a' end as age, coalesce(s.n, 0) as up, coalesce(t.n, 0) as down from u p join u q on p.p_brand = q.p_brand and p.p_type < q.p_type
      left join s on s.p_brand = p.p_brand and s.a = p.p_type and s.b = q.p_type left join s t on t.p_brand = p.p_brand and t.a = q.p_type and t.b = p.p_type)
    select p_brand, a, b, case when age = 'a over b' then case when down >= 3 and down > up then 'conflict' else age end when age = 'b over a' then case when up >= 3 and up > down then 'conflict' else age end when up >= 3 and down = 0 then 'a over b' when down >= 3 and up = 0 then 'b over a' else 'unordered' end as relation from j""",
    "part",
)
def age_constraints(part: DataFrame) -> DataFrame:
    """Which of two units lies above: by ages, else by what places show; contradictions told."""
    units = part.groupBy("p_brand", "p_type").agg(F.min("p_size").cast("double").alias("young"), (F.min("p_size") + F.count("*") % 4 + 1.0).alias("old"))
    tops = part.groupBy("p_brand", "p_name", "p_type").agg(F.min("p_retailprice").alias("d"))
    pairs = tops.alias("l").join(tops.alias("r"), (F.col("l.p_brand") == F.col("r.p_brand")) & (F.col("l.p_name") == F.col("r.p_name")) & (F.col("l.p_type") != F.col("r.p_type")) & (F.col("l.d") < F.col("r.d")))
    above = pairs.groupBy(F.col("l.p_brand").alias("p_brand"), F.col("l.p_type").alias("a"), F.col("r.p_type").alias("b")).agg(F.count("*").alias("n"))
    return geostat.order_constraints(units, above, "p_brand", "p_type", "young", "old").drop("basis")


@query(
    """with p as (select vec_id, embedding[3]::double as a, embedding[4]::double as b, abs(embedding[5]::double) + 0.01 as va, abs(embedding[6]::double) + 0.01 as vb from embeddings)
    select vec_id, round(case when a < b then (a / va + b / vb) / (1 / va + 1 / vb) else a end, 6) as upper, round(case when a < b then (a / va + b / vb) / (1 / va + 1 / vb) else b end, 6) as lower, round(case when a < b then sqrt(greatest(va, vb)) end, 6) as std from p""",
    "embeddings",
)
def stack_pairs(embeddings: DataFrame) -> DataFrame:
    """Two surfaces kept in order at each place."""
    e = lambda i: F.get("embedding", i).cast("double")
    rows = embeddings.select("vec_id", e(2).alias("a"), e(3).alias("b"), (F.abs(e(4)) + 0.01).alias("va"), (F.abs(e(5)) + 0.01).alias("vb"))
    upper, lower, std = geostat.stacked_pair(F.col("a"), F.col("b"), F.col("va"), F.col("vb"))
    return rows.select("vec_id", F.round(upper, 6).alias("upper"), F.round(lower, 6).alias("lower"), F.round(std, 6).alias("std"))


@query(
    """with l as (select l_partkey, l_suppkey, sum(l_quantity) as w, case min(l_returnflag) when 'A' then 1.0 when 'N' then 0.5 else 0.0 end as a from lineitem group by 1, 2), s as (select l_partkey, sum(a * w) / sum(w) as agr, count(*) as n from l group by 1),
    t as (select l_partkey, string_agg(l_suppkey::varchar, ',' order by w desc, l_suppkey) as top from (select *, row_number() over (partition by l_partkey order by w desc, l_suppkey) as k from l where a < 1) where k <= 5 group by 1)
    select p_partkey, round(least(1.0, b * (case when agr is null then 0.92 else 0.8 + 0.25 * agr end) + case when p_type = 'PROMO' then 0.03 else 0 end)::double, 12) as confidence, round(agr, 6) as agreement, 1 + coalesce(n, 0) as sources, top
    from (select *, (case when p_size <= 10 then 0.95 when p_size <= 25 then 0.9 when p_size <= 40 then 0.7 else 0.35 end) * (case when p_brand in ('Brand#1', 'Brand#2') then 1.0 when p_brand = 'Brand#3' then 0.8 else 0.9 end) as b from part) left join s on l_partkey = p_partkey left join t using (l_partkey)""",
    "part",
    "lineitem",
)
def merge_confidence(part: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Confidence of a winner from its scale, identity and the weighted agreement of others; the five largest that do
    not agree fully."""
    others = lineitem.groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("w"), F.min("l_returnflag").alias("flag"))
    others = others.withColumn("a", F.when(F.col("flag") == "A", 1.0).when(F.col("flag") == "N", 0.5).otherwise(0.0))
    best = F.slice(F.sort_array(F.collect_list(F.when(F.col("a") < 1, F.struct((-F.col("w")).alias("w"), F.col("l_suppkey").alias("i"))))), 1, 5)
    sums = others.groupBy("l_partkey").agg(F.try_divide(F.sum(F.col("a") * F.col("w")), F.sum("w")).alias("agr"), F.count("*").alias("n"), best.alias("best"))
    identity = F.when(F.col("p_brand").isin("Brand#1", "Brand#2"), "certain").when(F.col("p_brand") == "Brand#3", "questionable")
    base = rules.steps(F.col("p_size"), [(10, 0.95), (25, 0.9), (40, 0.7)], 0.35, 0.35) * rules.identity_weight(identity)
    value = rules.merged_confidence(base, F.col("agr"), F.col("p_type") == "PROMO")
    top = F.when(F.size("best") > 0, F.array_join(F.transform("best", lambda b: b["i"].cast("string")), ","))
    return part.join(sums, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", F.round(value, 12).alias("confidence"), F.round("agr", 6).alias("agreement"), (1 + F.coalesce("n", F.lit(0))).alias("sources"), top.alias("top"))


@query(
    """select doc_id, round(least(1.0, greatest(0.0, (case when source in ('src1', 'src2', 'src3') then 0.95 else 0.7 end) * (case when lang <> 'en' then 0.9 else 1.0 end) * (case when n_chars < 500 then 0.8 when n_chars < 2000 then 0.95 else 1.0 end) * (case when quality = 1 then 1.0 when quality = 0 then 0.5 else 0.85 end) * (case when toxic = 1 then 0.75 else 1.0 end)))::double, 10) as confidence,
      case when confidence >= 0.7 then 'High' when confidence >= 0.4 then 'Medium' else 'Low' end as level from documents left join labels using (doc_id)""",
    "documents",
    "labels",
)
def extraction_confidence(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The product of factors of source, method, match, verdict and inference, and its level."""
    s = F.when(F.col("source").isin("src1", "src2", "src3"), 0.95).otherwise(0.7)
    m = F.when(F.col("lang") != "en", 0.9).otherwise(1.0)
    q = F.when(F.col("n_chars") < 500, 0.8).when(F.col("n_chars") < 2000, 0.95).otherwise(1.0)
    v = F.when(F.col("quality") == 1, 1.0).when(F.col("quality") == 0, 0.5).otherwise(0.85)
    i = F.when(F.col("toxic") == 1, 0.75).otherwise(1.0)
    value = F.round(rules.clamp(s * m * q * v * i), 10)
    return documents.join(labels, "doc_id", "left").select("doc_id", value.alias("confidence"), rules.confidence_level(value).alias("level"))
