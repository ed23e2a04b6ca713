"""Catalog: key partitioners (murmur2) and tenant routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.functions.murmur2 import murmur2, murmur2_sql_ctes
from flowlens.operators import routing as R
from flowlens.plans.registry import register
from flowlens.sources import fixtures as fx
from flowlens.sources.fixtures_sql import with_fixtures


# ------------------------------------------------------------------ partitioners
def _hash_sql(body: str, text: str = "coalesce(key, value)") -> str:
    """Oracle SQL over the routing keys with ``h`` = murmur2(text) and ``hp``
    its positive form (``h & 0x7fffffff``)."""
    ctes = murmur2_sql_ctes("routing_keys", text, "h", "mm")
    ctes["hashed"] = "SELECT *, CAST(h AS BIGINT) & 2147483647 AS hp FROM mm5"
    return with_fixtures(body, "routing_keys", extra=ctes)


def _range_sql(start: int, count: int) -> str:
    es = f"least({start}, num_partitions - 1)"
    ec = f"least({count}, num_partitions - {es})"
    return f"CASE WHEN {ec} <= 0 THEN hp % num_partitions ELSE {es} + hp % {ec} END"


_BUSINESS = f"""CAST(CASE WHEN key IS NULL THEN hp % num_partitions
  WHEN starts_with(upper(key), 'ORDER-') THEN {_range_sql(0, 3)}
  WHEN starts_with(upper(key), 'PAYMENT-') THEN {_range_sql(3, 3)}
  WHEN starts_with(upper(key), 'INVENTORY-') OR starts_with(upper(key), 'PRODUCT-') THEN {_range_sql(6, 3)}
  ELSE hp % num_partitions END AS INTEGER)"""


@register("murmur2_hash", _hash_sql("SELECT event_id, key, h AS murmur2 FROM hashed"))
def q_murmur2_hash(spark, sf):
    """murmur2 of each routing key (NULL keys hash their value bytes)."""
    k = fx.routing_keys(spark, sf)
    return k.select("event_id", "key", murmur2(F.coalesce("key", "value")).alias("murmur2"))


@register("business_key_partition", _hash_sql(f"SELECT event_id, key, num_partitions, {_BUSINESS} AS partition FROM hashed"))
def q_business_key_partition(spark, sf):
    k = fx.routing_keys(spark, sf)
    return k.select("event_id", "key", "num_partitions", R.business_key_partition().alias("partition"))


_CID = ("CASE WHEN starts_with(upper(key), 'CUSTOMER-') OR starts_with(upper(key), 'CUST-') THEN substr(key, instr(key, '-') + 1) "
        "WHEN regexp_full_match(key, '[A-Za-z0-9_-]+') THEN key END")


@register("vip_customer_partition", _hash_sql(f"""
SELECT event_id, key, num_partitions, CAST(CASE WHEN key IS NULL THEN hp % num_partitions
  WHEN {_CID} IN ({", ".join("'" + v + "'" for v in fx.VIP_CUSTOMERS)}) THEN least(0, num_partitions - 1)
  WHEN num_partitions - 1 > 0 THEN 1 + hp % (num_partitions - 1) ELSE hp % num_partitions END AS INTEGER) AS partition
FROM hashed"""))
def q_vip_customer_partition(spark, sf):
    k = fx.routing_keys(spark, sf)
    return k.select("event_id", "key", "num_partitions", R.vip_customer_partition(fx.VIP_CUSTOMERS).alias("partition"))


def _any_prefix(ps):
    return " OR ".join(f"starts_with(upper(coalesce(key, '')), '{p}')" for p in ps)


_PRIO = (f"CASE WHEN {_any_prefix(R.HIGH_PREFIXES)} THEN 'HIGH' WHEN {_any_prefix(R.MEDIUM_PREFIXES)} THEN 'MEDIUM' "
         f"WHEN {_any_prefix(R.LOW_PREFIXES)} THEN 'LOW' ELSE 'DEFAULT' END")
_STRIP = ("CASE " + " ".join(f"WHEN starts_with(upper(coalesce(key, '')), '{p}') THEN substr(coalesce(key, ''), {len(p) + 1})"
                             for p in R.HIGH_PREFIXES + R.MEDIUM_PREFIXES + R.LOW_PREFIXES) + " ELSE coalesce(key, '') END")
_PRIO_PART = """CAST(CASE WHEN num_partitions = 1 THEN 0 WHEN priority = 'HIGH' THEN least(0, num_partitions - 1)
  WHEN priority = 'MEDIUM' THEN CASE WHEN least(2, num_partitions - least(1, num_partitions - 1)) <= 0 THEN hp % num_partitions
    ELSE least(1, num_partitions - 1) + hp % least(2, num_partitions - least(1, num_partitions - 1)) END
  ELSE least(3, num_partitions - 1) + hp % greatest(num_partitions - least(3, num_partitions - 1), 1) END AS INTEGER)"""


@register("priority_partition", _hash_sql(f"SELECT event_id, key, num_partitions, priority, {_PRIO_PART} AS partition "
                                          f"FROM (SELECT *, {_PRIO} AS priority FROM hashed)", text=_STRIP))
def q_priority_partition(spark, sf):
    k = fx.routing_keys(spark, sf)
    return k.select("event_id", "key", "num_partitions", R.priority_of().alias("priority"),
                    R.priority_partition().alias("partition"))


@register("partition_distribution", _hash_sql(
    f"SELECT num_partitions, {_BUSINESS} AS partition, count(*) AS message_count FROM hashed GROUP BY ALL"))
def q_partition_distribution(spark, sf):
    k = fx.routing_keys(spark, sf).withColumn("partition", R.business_key_partition())
    return k.groupBy("num_partitions", "partition").agg(F.count(F.lit(1)).alias("message_count"))


# ------------------------------------------------------------------ tenants
_REST = "CASE WHEN starts_with(topic, 'tenant-') THEN substr(topic, 8) END"
_FIRST = f"CASE WHEN contains({_REST}, '-') THEN split_part({_REST}, '-', 1) END"
_KEYT = "CASE WHEN contains(key, ':') THEN split_part(key, ':', 1) END"
_EXTRACT = f"""SELECT m.*, coalesce(tenant_header, {_KEYT},
  (SELECT arg_max(t.tenant_id, length(t.tenant_id)) FROM tenants t WHERE starts_with({_REST}, t.tenant_id || '-')),
  {_FIRST}) AS tenant_id FROM tenant_messages m"""
_EXTRACT_PARITY = f"SELECT m.*, coalesce(tenant_header, {_KEYT}, {_FIRST}) AS tenant_id FROM tenant_messages m"
_MSG_COLS = "event_id, topic, key, value, tenant_header, target_tier"


def _tq(body, **extra):
    return with_fixtures(body, "tenants", "tenant_messages", extra=extra or None)


def _msgs(spark, sf):
    return R.extract_tenant(fx.tenant_messages(spark, sf), fx.tenants(spark, sf))


@register("extract_tenant", _tq("SELECT * FROM ext", ext=_EXTRACT))
def q_extract_tenant(spark, sf):
    return _msgs(spark, sf)


@register("extract_tenant_parity", _tq("SELECT * FROM ext", ext=_EXTRACT_PARITY))
def q_extract_tenant_parity(spark, sf):
    return R.extract_tenant(fx.tenant_messages(spark, sf), strict_parity=True)


@register("tenant_admission", _tq(f"""
SELECT {_MSG_COLS}, e.tenant_id, CASE WHEN e.tenant_id IS NULL OR t.is_active IS NULL THEN 'DROPPED'
  WHEN NOT t.is_active THEN 'DENIED' ELSE 'ACCEPTED' END AS admission
FROM ext e LEFT JOIN tenants t USING (tenant_id)""", ext=_EXTRACT))
def q_tenant_admission(spark, sf):
    return R.tenant_admission(_msgs(spark, sf), fx.tenants(spark, sf))


@register("route_messages", _tq("""
SELECT tenant_id, 'tenant-' || tenant_id || '-order-events' AS route_topic, key AS route_key, tenant_id AS route_header,
  value AS route_value FROM ext WHERE tenant_id IS NOT NULL""", ext=_EXTRACT))
def q_route_messages(spark, sf):
    return R.route_messages(_msgs(spark, sf).filter(F.col("tenant_id").isNotNull()), "order-events")


@register("tenant_topic", _tq("SELECT event_id, 'tenant-' || tenant_id || '-order-events' AS tenant_topic, "
                              "'tenant-' || tenant_id || '-*' AS tenant_pattern FROM ext", ext=_EXTRACT))
def q_tenant_topic(spark, sf):
    m = _msgs(spark, sf)
    return m.select("event_id", R.tenant_topic(F.lit("order-events"), "tenant_id").alias("tenant_topic"),
                    R.tenant_pattern("tenant_id").alias("tenant_pattern"))


@register("tenant_key", _tq("SELECT event_id, tenant_id || ':' || key AS tenant_key, "
                            "'order-group-' || tenant_id AS tenant_group FROM ext", ext=_EXTRACT))
def q_tenant_key(spark, sf):
    m = _msgs(spark, sf)
    return m.select("event_id", R.tenant_key("key", "tenant_id").alias("tenant_key"),
                    R.tenant_group(F.lit("order-group"), "tenant_id").alias("tenant_group"))


@register("tenant_broadcast", _tq(f"""
SELECT {_MSG_COLS}, t.tenant_id FROM tenant_messages m JOIN (
  SELECT tenant_id, tier AS target FROM tenants WHERE is_active UNION ALL SELECT tenant_id, 'ALL' FROM tenants WHERE is_active) t
ON m.target_tier = t.target"""))
def q_tenant_broadcast(spark, sf):
    return R.tenant_broadcast(fx.tenant_messages(spark, sf), fx.tenants(spark, sf))


@register("active_tenants", _tq("SELECT * FROM tenants WHERE is_active"))
def q_active_tenants(spark, sf):
    return R.active_tenants(fx.tenants(spark, sf))


@register("tenants_by_tier", _tq("SELECT * FROM tenants WHERE tier = 'PREMIUM'"))
def q_tenants_by_tier(spark, sf):
    return R.tenants_by_tier(fx.tenants(spark, sf), "PREMIUM")


@register("is_valid_tenant", _tq("""SELECT e.tenant_id, coalesce(t.is_active, FALSE) AS is_valid
FROM (SELECT DISTINCT tenant_id FROM ext WHERE tenant_id IS NOT NULL) e LEFT JOIN tenants t USING (tenant_id)""", ext=_EXTRACT))
def q_is_valid_tenant(spark, sf):
    ids = _msgs(spark, sf).select("tenant_id").filter(F.col("tenant_id").isNotNull()).distinct()
    return R.is_valid_tenant(fx.tenants(spark, sf), ids)


def _updates(spark, sf):
    """Tier upgrades for region 1 plus unknown ids for region 2 (ignored)."""
    n = fx.table(spark, sf, "nation", "n_nationkey", "n_name", "n_regionkey").filter(F.col("n_regionkey").isin(1, 2))
    k = F.col("n_nationkey") + F.when(F.col("n_regionkey") == 2, F.lit(100)).otherwise(F.lit(0))
    return n.select(F.concat(F.lit("tenant-"), k.cast("string")).alias("tenant_id"), F.col("n_name").alias("tenant_name"),
                    F.lit("ENTERPRISE").alias("tier"), F.lit(True).alias("is_active"),
                    F.lit(10000).alias("max_messages_per_second"))


_UPD_SQL = """SELECT 'tenant-' || (n_nationkey + CASE WHEN n_regionkey = 2 THEN 100 ELSE 0 END) AS tenant_id, n_name AS tenant_name,
  'ENTERPRISE' AS tier, TRUE AS is_active, 10000 AS max_messages_per_second FROM nation WHERE n_regionkey IN (1, 2)"""


@register("tenant_upsert", _tq("""SELECT * FROM tenants WHERE tenant_id NOT IN (SELECT tenant_id FROM upd WHERE tenant_id IN (SELECT tenant_id FROM tenants))
UNION ALL SELECT * FROM upd WHERE tenant_id IN (SELECT tenant_id FROM tenants)""", upd=_UPD_SQL))
def q_tenant_upsert(spark, sf):
    return R.tenant_upsert(fx.tenants(spark, sf), _updates(spark, sf))


def _region_ids(spark, sf, region):
    n = fx.table(spark, sf, "nation", "n_nationkey", "n_regionkey").filter(F.col("n_regionkey") == region)
    return n.select(F.concat(F.lit("tenant-"), F.col("n_nationkey").cast("string")).alias("tenant_id"))


_RIDS = "SELECT 'tenant-' || n_nationkey AS tenant_id FROM nation WHERE n_regionkey = {r}"


@register("tenant_deactivate", _tq("SELECT tenant_id, tenant_name, tier, CASE WHEN tenant_id IN (SELECT tenant_id FROM ids) "
                                   "THEN FALSE ELSE is_active END AS is_active, max_messages_per_second FROM tenants",
                                   ids=_RIDS.format(r=3)))
def q_tenant_deactivate(spark, sf):
    return R.tenant_set_active(fx.tenants(spark, sf), _region_ids(spark, sf, 3), False)


@register("tenant_activate", _tq("SELECT tenant_id, tenant_name, tier, CASE WHEN tenant_id IN (SELECT tenant_id FROM ids) "
                                 "THEN TRUE ELSE is_active END AS is_active, max_messages_per_second FROM tenants",
                                 ids=_RIDS.format(r=4)))
def q_tenant_activate(spark, sf):
    return R.tenant_set_active(fx.tenants(spark, sf), _region_ids(spark, sf, 4), True)


@register("tenant_remove", _tq("SELECT * FROM tenants WHERE tenant_id NOT IN (SELECT tenant_id FROM ids)", ids=_RIDS.format(r=0)))
def q_tenant_remove(spark, sf):
    return R.tenant_remove(fx.tenants(spark, sf), _region_ids(spark, sf, 0))


@register("tenant_group", _tq("SELECT DISTINCT tenant_id, 'order-group-' || tenant_id AS tenant_group, "
                              "'tenant-' || tenant_id || '-*' AS tenant_pattern FROM ext WHERE tenant_id IS NOT NULL",
                              ext=_EXTRACT))
def q_tenant_group(spark, sf):
    m = _msgs(spark, sf).select("tenant_id").filter(F.col("tenant_id").isNotNull()).distinct()
    return m.select("tenant_id", R.tenant_group(F.lit("order-group"), "tenant_id").alias("tenant_group"),
                    R.tenant_pattern("tenant_id").alias("tenant_pattern"))
