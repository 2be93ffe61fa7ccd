"""Queries of records that are wanted. Customers stand for sites, orders for records with work, pages for addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.functions import choices
from strataflow.registry import query


@query(
    """select c_custkey, kind in ('well', 'core', 'spring') as site, not inferred or coalesce(radius <= 1609, false) as near
    from (select c_custkey, case c_nationkey % 5 when 0 then 'well' when 1 then 'core' when 2 then 'outcrop' when 3 then 'spring' end as kind, c_mktsegment <> 'BUILDING' as inferred, case when c_acctbal > 0 then c_acctbal end as radius from customer) where kind is not null union all
    select c_custkey, false, c_mktsegment = 'BUILDING' or (c_acctbal > 0 and c_acctbal <= 1609) from customer where c_nationkey % 5 = 4""",
    "customer",
)
def sites_known(customer: DataFrame) -> DataFrame:
    """Which sites are holes or springs, and which are known to a mile."""
    n = F.col("c_nationkey") % 5
    kind = F.when(n == 0, "well").when(n == 1, "core").when(n == 2, "outcrop").when(n == 3, "spring")
    radius = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))
    return customer.select("c_custkey", choices.is_site(kind).alias("site"), choices.within(F.col("c_mktsegment") != "BUILDING", radius).alias("near"))


@query("select page_id, coalesce(regexp_matches(url, '^https?://') and not regexp_matches(url, '[02468]$'), false) as allowed from pages", "pages")
def addresses_allowed(pages: DataFrame) -> DataFrame:
    """Which addresses may be asked."""
    return pages.select("page_id", choices.allowed(F.col("url"), "[02468]$").alias("allowed"))


@query(
    "select p_partkey, case when p_size % 4 = 0 or p_size % 7 = 0 or p_partkey % 3 = 0 then 'map' else 'publication' end as kind from part",
    "part",
)
def record_kinds(part: DataFrame) -> DataFrame:
    """Maps and publications, by themes, sheets and titles."""
    themes, sheets = F.when(F.col("p_size") % 4 == 0, F.array("p_brand")), F.when(F.col("p_size") % 7 == 0, F.array("p_type")).otherwise(F.array().cast("array<string>"))
    title = F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, ", Map of").otherwise(" mapped"))
    return part.select("p_partkey", choices.record_kind(themes, sheets, title).alias("kind"))


@query(
    """with o as (select o_orderkey, o_orderdate, case when o_custkey % 6 > 0 then 1 end as candidates, o_custkey % 5 = 0 as skipped, o_custkey % 11 = 0 as failed, case o_orderstatus when 'F' then 'text' when 'O' then 'needs_ocr' end as status, o_orderkey % 3 as version, o_orderkey % 4 as missing, case when o_orderkey % 7 > 0 then o_orderkey % 5 end as attempts from orders)
    select o_orderkey, candidates is null or skipped or failed or (coalesce(status, '') <> 'text' and version <> 2) as stale, coalesce(attempts, 0) < 3 and (coalesce(status, '') = 'needs_ocr' or (coalesce(status, '') = 'text' and missing > 0)) as retry, 'data-' || strftime(o_orderdate, '%Y%m%d-%H%M') as tag from o""",
    "orders",
)
def work_due(orders: DataFrame) -> DataFrame:
    """Records whose sources must be looked up, or whose pages must be read again, and tags of their times."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    status = F.when(F.col("o_orderstatus") == "F", "text").when(F.col("o_orderstatus") == "O", "needs_ocr")
    looked = choices.stale(F.when(c % 6 > 0, 1), c % 5 == 0, c % 11 == 0, status, k % 3, 2, True)
    again = choices.retry_due(status, k % 4, F.when(k % 7 > 0, k % 5))
    return orders.select("o_orderkey", looked.alias("stale"), again.alias("retry"), choices.tag(F.col("o_orderdate")).alias("tag"))
