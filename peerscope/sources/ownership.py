"""Who owns an address: ownership records, the metadata table, enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerscope.functions.columns import owner_name, record_field
from peerscope.schema import LOCAL_ORG


def resolve_records(records: DataFrame) -> DataFrame:
    """Ownership records ``(ip_address, record JSON)`` to metadata rows."""
    record = F.col("record")
    return records.select(
        "ip_address",
        owner_name(record).alias("org"),
        record_field(record, "hostname").alias("hostname"),
        record_field(record, "loc").alias("location"),
    )


def seed_local_host(owners: DataFrame, host_ip: str) -> DataFrame:
    """``owners`` ``(ip_address, org)`` with the capture host owned by the local org."""
    seed = owners.sparkSession.createDataFrame([(host_ip, LOCAL_ORG)], "ip_address string, org string")
    return owners.unionByName(seed).distinct()


def one_owner(owners: DataFrame) -> DataFrame:
    """One owner per address: the local org wins, then the lowest name."""
    return owners.groupBy("ip_address").agg(
        F.min(F.struct((F.col("org") != LOCAL_ORG).alias("remote"), F.col("org"))).alias("best")
    ).select("ip_address", F.col("best.org").alias("org"))


def _lowest(rows: DataFrame, *columns: str) -> DataFrame:
    """One row per address, whatever the order of ``rows``: the lowest values, known before unknown."""
    order = [part for c in columns for part in (F.col(c).isNull().alias(f"no_{c}"), F.col(c))]
    return rows.groupBy("ip_address").agg(F.min(F.struct(*order)).alias("best")).select(
        "ip_address", *[F.col("best").getField(c).alias(c) for c in columns]
    )


def ip_metadata(addresses: DataFrame, owners: DataFrame, hosts: DataFrame) -> DataFrame:
    """Metadata of every address; org, hostname and location are null if unknown.

    ``hosts`` is ``(ip_address, hostname, location)``.
    """
    return (
        addresses.select("ip_address")
        .join(one_owner(owners), "ip_address", "left")
        .join(_lowest(hosts, "hostname", "location"), "ip_address", "left")
        .select("ip_address", "org", "hostname", "location")
    )


def undocumented(addresses: DataFrame, metadata: DataFrame) -> DataFrame:
    """Addresses without an owner."""
    owned = metadata.filter("org IS NOT NULL").select("ip_address")
    return addresses.select("ip_address").distinct().join(owned, "ip_address", "left_anti")


def enrich(missing: DataFrame, records: DataFrame) -> DataFrame:
    """Metadata of the ``missing`` addresses that have an ownership record."""
    wanted = records.join(missing.select("ip_address"), "ip_address", "left_semi")
    return _lowest(resolve_records(wanted), "org", "hostname", "location")


def upsert_metadata(current: DataFrame, new: DataFrame) -> DataFrame:
    """``current`` with the rows of ``new`` added or replacing theirs."""
    columns = ["ip_address", "org", "hostname", "location"]
    kept = current.join(new.select("ip_address"), "ip_address", "left_anti")
    return kept.select(columns).unionByName(new.select(columns))


def host_ips(metadata: DataFrame) -> DataFrame:
    """Addresses of the capture host."""
    return metadata.filter(F.col("org") == LOCAL_ORG).select("ip_address").distinct()
