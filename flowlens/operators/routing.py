"""Key partitioners and tenant routing.

Partitioners: the only Python is the vectorized murmur2 UDF; prefix tests,
ranges and clamping are built-in expressions on its result.

Tenants: every lookup is an equi-join with the registry, without a hint:
Spark's byte threshold and AQE decide whether the registry is broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions.murmur2 import murmur2, to_positive

# Partitioner defaults (business key ranges, priority prefixes).
ORDER_RANGE = (0, 3)
PAYMENT_RANGE = (3, 3)
INVENTORY_RANGE = (6, 3)
HIGH_PREFIXES = ["HIGH:", "P1:", "URGENT:", "CRITICAL:"]
MEDIUM_PREFIXES = ["MEDIUM:", "P2:", "NORMAL:"]
LOW_PREFIXES = ["LOW:", "P3:", "BATCH:"]
TENANT_HEADER = "X-Tenant-Id"
TOPIC_PREFIX, SEPARATOR = "tenant", "-"
SALTS = 64  # keys over which the messages of one topic are dealt


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _range(h: Column, start: int, count: int, n: Column) -> Column:
    eff_start = F.least(F.lit(start), n - 1)
    eff_count = F.least(F.lit(count), n - eff_start)
    return F.when(eff_count <= 0, h % n).otherwise(eff_start + h % F.greatest(eff_count, F.lit(1)))


def business_key_partition(key="key", value="value", num_partitions="num_partitions") -> Column:
    """ORDER- / PAYMENT- / INVENTORY- or PRODUCT- (any case) → their
    partition ranges clamped to the topic; other keys murmur2 % n; no key →
    murmur2 of the value bytes."""
    k, n = _c(key), _c(num_partitions)
    u = F.upper(k)
    hk = to_positive(murmur2(F.coalesce(k, _c(value))))  # the value counts only without a key
    return (F.when(k.isNull(), hk % n)
            .when(u.startswith("ORDER-"), _range(hk, *ORDER_RANGE, n))
            .when(u.startswith("PAYMENT-"), _range(hk, *PAYMENT_RANGE, n))
            .when(u.startswith("INVENTORY-") | u.startswith("PRODUCT-"), _range(hk, *INVENTORY_RANGE, n))
            .otherwise(hk % n)).cast("int")


def vip_customer_partition(vip_ids: list[str], key="key", value="value", num_partitions="num_partitions",
                           vip_partition: int = 0) -> Column:
    """VIP customers → the VIP partition; others ``1 + h % (n − 1)``
    (assumes the VIP partition is 0, as the reference does); no key → value hash."""
    k, n = _c(key), _c(num_partitions)
    cid = F.when(F.upper(k).startswith("CUSTOMER-") | F.upper(k).startswith("CUST-"),
                 F.substring(k, F.instr(k, "-") + 1, 1 << 30)).when(k.rlike("^[A-Za-z0-9_-]+$"), k)
    hk = to_positive(murmur2(F.coalesce(k, _c(value))))
    vip = F.least(F.greatest(F.lit(vip_partition), F.lit(0)), n - 1)
    return (F.when(k.isNull(), hk % n).when(cid.isin(*vip_ids), vip)
            .when(n - 1 > 0, 1 + hk % F.greatest(n - 1, F.lit(1))).otherwise(hk % n)).cast("int")


def priority_of(key="key") -> Column:
    u = F.upper(F.coalesce(_c(key), F.lit("")))
    any_of = lambda ps: reduce(lambda a, b: a | b, [u.startswith(p) for p in ps])
    return (F.when(any_of(HIGH_PREFIXES), "HIGH").when(any_of(MEDIUM_PREFIXES), "MEDIUM")
            .when(any_of(LOW_PREFIXES), "LOW").otherwise("DEFAULT"))


def strip_priority(key="key") -> Column:
    k = F.coalesce(_c(key), F.lit(""))
    u = F.upper(k)
    e = None
    for p in HIGH_PREFIXES + MEDIUM_PREFIXES + LOW_PREFIXES:
        e = (F.when(u.startswith(p), F.substring(k, len(p) + 1, 1 << 30)) if e is None
             else e.when(u.startswith(p), F.substring(k, len(p) + 1, 1 << 30)))
    return e.otherwise(k)


def priority_partition(key="key", num_partitions="num_partitions", high: int = 0, medium_start: int = 1,
                       medium_count: int = 2) -> Column:
    """F16: HIGH/P1/URGENT/CRITICAL → partition 0; MEDIUM/P2/NORMAL → 1–2;
    the rest → 3+; the prefix is stripped before hashing."""
    n = _c(num_partitions)
    pr = priority_of(key)
    h = to_positive(murmur2(strip_priority(key)))
    m_start = F.least(F.greatest(F.lit(medium_start), F.lit(0)), n - 1)
    m_count = F.least(F.lit(medium_count), n - m_start)
    medium = F.when(m_count <= 0, h % n).otherwise(m_start + h % F.greatest(m_count, F.lit(1)))
    low_start = F.least(F.lit(1 + medium_count), n - 1)
    low = low_start + h % F.greatest(n - low_start, F.lit(1))
    return (F.when(n == 1, 0).when(pr == "HIGH", F.least(F.greatest(F.lit(high), F.lit(0)), n - 1))
            .when(pr == "MEDIUM", medium).otherwise(low)).cast("int")


def partition_distribution(df: DataFrame, partition_col: str = "partition") -> DataFrame:
    """Messages per computed partition."""
    return df.groupBy(partition_col).agg(F.count(F.lit(1)).alias("message_count"))


# ------------------------------------------------------------------ tenants
def tenant_topic(base_topic, tenant_id, strategy: str = "TOPIC_PER_TENANT") -> Column:
    """``tenant-{id}-{base}`` for topic-per-tenant, else the shared topic."""
    if strategy == "TOPIC_PER_TENANT":
        return F.concat(F.lit(TOPIC_PREFIX + SEPARATOR), _c(tenant_id), F.lit(SEPARATOR), _c(base_topic))
    return _c(base_topic)


def tenant_key(base_key, tenant_id, strategy: str = "SHARED_TOPIC_WITH_KEY_PREFIX") -> Column:
    """``{id}:{key}`` for the key-prefix strategy, else the key."""
    if strategy == "SHARED_TOPIC_WITH_KEY_PREFIX":
        return F.concat(_c(tenant_id), F.lit(":"), _c(base_key))
    return _c(base_key)


def tenant_group(base_group, tenant_id) -> Column:
    """consumer group ``{group}-{id}``."""
    return F.concat(_c(base_group), F.lit(SEPARATOR), _c(tenant_id))


def tenant_pattern(tenant_id) -> Column:
    """subscription pattern ``tenant-{id}-*``."""
    return F.concat(F.lit(TOPIC_PREFIX + SEPARATOR), _c(tenant_id), F.lit(SEPARATOR + "*"))


def _topic_rest(topic: Column) -> Column:
    pre = TOPIC_PREFIX + SEPARATOR
    return F.when(topic.startswith(pre), F.substring(topic, len(pre) + 1, 1 << 30))


def extract_tenant(messages: DataFrame, tenants: DataFrame | None = None, strict_parity: bool = False) -> DataFrame:
    """tenant from the header, else the key before the first ``:``, else
    the topic segment after ``tenant-``.

    The reference cuts the topic at the first separator, so ``tenant-tenant-a-x``
    yields ``tenant`` (``strict_parity``). By default the longest *registered*
    tenant id that prefixes the rest of the topic wins: the distinct topics'
    prefixes meet the registry in one equi-join, and the longest hit per topic
    joins back. Most messages may share a topic, so a topic's messages are dealt over
    ``SALTS`` keys and its hit is repeated for each.
    """
    m = messages
    rest = _topic_rest(F.col("topic"))
    first_seg = F.when(F.instr(rest, SEPARATOR) > 0, F.substring_index(rest, SEPARATOR, 1))
    from_key = F.when(F.instr(F.col("key"), ":") > 0, F.substring_index(F.col("key"), ":", 1))
    topic_tenant = first_seg
    if not strict_parity and tenants is not None:
        parts = F.split(rest, SEPARATOR)
        n = F.size(parts) - 1  # a candidate leaves at least one segment of the topic
        prefixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, 1, i), SEPARATOR))
        topics = messages.select("topic").distinct().filter(rest.isNotNull() & (n > 0))
        cands = topics.select("topic", F.explode(prefixes).alias("_cand"))
        reg = tenants.select(F.col("tenant_id").alias("_cand")).distinct()
        longest = (cands.join(reg, "_cand").groupBy(F.col("topic").alias("_topic"))
                   .agg(F.max_by("_cand", F.length("_cand")).alias("_hit")))
        hits = longest.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_hit_salt"))
        m = m.withColumn("_salt", (F.monotonically_increasing_id() % SALTS).cast("int")).join(
            hits, (F.col("topic") == F.col("_topic")) & (F.col("_salt") == F.col("_hit_salt")), "left")
        topic_tenant = F.coalesce(F.col("_hit"), first_seg)
    out = m.withColumn("tenant_id", F.coalesce(F.col("tenant_header"), from_key, topic_tenant))
    return out.select(*messages.columns, "tenant_id")


def tenant_admission(messages: DataFrame, tenants: DataFrame) -> DataFrame:
    """Unknown tenant → DROPPED, inactive → DENIED, else ACCEPTED."""
    t = tenants.select("tenant_id", F.col("is_active").alias("_active"))
    j = messages.join(t, "tenant_id", "left")
    d = (F.when(F.col("tenant_id").isNull() | F.col("_active").isNull(), "DROPPED")
         .when(~F.col("_active"), "DENIED").otherwise("ACCEPTED"))
    return j.withColumn("admission", d).drop("_active")


def route_messages(messages: DataFrame, base_topic: str, strategy: str = "TOPIC_PER_TENANT") -> DataFrame:
    """a tenant send — destination topic, key, tenant header and value."""
    return messages.select(
        "tenant_id", tenant_topic(F.lit(base_topic), "tenant_id", strategy).alias("route_topic"),
        (tenant_key("key", "tenant_id") if strategy == "SHARED_TOPIC_WITH_KEY_PREFIX" else F.col("key")).alias("route_key"),
        F.col("tenant_id").alias("route_header"), F.col("value").alias("route_value"))


def tenant_broadcast(messages: DataFrame, tenants: DataFrame, target_col: str = "target_tier") -> DataFrame:
    """One copy of a broadcast message per target tenant. The target is a
    tier or ``ALL`` (active tenants); tenants are expanded to the targets they
    belong to and equi-joined, so the fan-out list is exactly the feature."""
    t = tenants.filter("is_active").select("tenant_id", F.explode(F.array(F.col("tier"), F.lit("ALL"))).alias("_target"))
    return messages.join(t, messages[target_col] == t["_target"]).drop("_target")


def tenant_broadcast_to(messages: DataFrame, tenants: DataFrame, ids_col: str = "target_ids") -> DataFrame:
    """One copy per active tenant of an explicit list (array column);
    unknown, inactive and repeated ids get none."""
    each = messages.withColumn("tenant_id", F.explode(F.array_distinct(ids_col)))
    return each.join(tenants.filter("is_active").select("tenant_id"), "tenant_id")


def active_tenants(tenants: DataFrame) -> DataFrame:
    """P16."""
    return tenants.filter("is_active")


def tenants_by_tier(tenants: DataFrame, tier: str) -> DataFrame:
    """P16."""
    return tenants.filter(F.col("tier") == tier)


def is_valid_tenant(tenants: DataFrame, ids: DataFrame) -> DataFrame:
    """Registered and active, for each requested id."""
    t = tenants.select("tenant_id", "is_active")
    return ids.join(t, "tenant_id", "left").select("tenant_id", F.coalesce("is_active", F.lit(False)).alias("is_valid"))


def tenant_upsert(tenants: DataFrame, updates: DataFrame, update_only: bool = True) -> DataFrame:
    """Register (insert or replace) or, ``update_only``, replace existing tenants only."""
    if update_only:
        updates = updates.join(tenants.select("tenant_id"), "tenant_id", "left_semi")
    keep = tenants.join(updates.select("tenant_id"), "tenant_id", "left_anti")
    return keep.unionByName(updates.select(*tenants.columns))


def tenant_set_active(tenants: DataFrame, ids: DataFrame, active: bool) -> DataFrame:
    """(de)activate the listed existing tenants."""
    hit = ids.select("tenant_id").distinct().withColumn("_hit", F.lit(True))
    j = tenants.join(hit, "tenant_id", "left")
    return j.select(*[F.when(F.col("_hit"), F.lit(active)).otherwise(F.col(c)).alias(c) if c == "is_active" else F.col(c)
                      for c in tenants.columns])


def tenant_remove(tenants: DataFrame, ids: DataFrame) -> DataFrame:
    """Remove tenants."""
    return tenants.join(ids.select("tenant_id"), "tenant_id", "left_anti")
