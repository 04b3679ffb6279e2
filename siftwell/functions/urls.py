"""Application urls: which board software, whose board."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as K
from .text import filled, or_empty


def _with_scheme(url: Column) -> Column:
    return F.when(url.contains("//"), url).otherwise(F.concat(F.lit("https://"), url))


def _netloc(url: Column) -> Column:
    return F.lower(F.regexp_extract(_with_scheme(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))


def host_of(url: Column) -> Column:
    return F.element_at(F.split(_netloc(url), ":", 2), 1)


def segments_of(url: Column) -> Column:
    path = F.regexp_extract(_with_scheme(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#;]*)", 1)
    return F.filter(F.split(path, "/"), lambda s: s != "")


def classify_apply_url(url: Column, company: Column) -> Column:
    """``struct(company, ats, tenant, wd, site)``, null where the url is not one of a modelled board.

    Hosts that are recognised but not modelled are null as well; :func:`known_host` tells them apart.
    """
    host, parts = host_of(url), segments_of(url)
    ats = F.try_element_at(F.create_map(*(F.lit(x) for pair in K.URL_HOSTS.items() for x in pair)), host)
    head = or_empty(F.get(parts, 0))
    asked = F.regexp_extract(or_empty(url), r"[?&]for=([^&#]+)", 1)
    asked = F.coalesce(F.try_url_decode(F.regexp_replace(asked, r"\+", " ")), F.lit(""))
    tenant = F.when((ats == "greenhouse") & head.isin(*K.URL_ROUTES), asked).otherwise(head)
    shard_tenant = F.regexp_extract(host, "(?i)" + K.SHARDED_HOST, 1)
    wd = F.regexp_extract(host, "(?i)" + K.SHARDED_HOST, 2)
    site = or_empty(F.get(F.filter(parts, lambda s: ~s.rlike(K.LOCALE)), 0))
    name = lambda t: F.coalesce(filled(company), t).alias("company")
    none = F.lit("")
    sharded = F.struct(name(shard_tenant), F.lit("workday").alias("ats"), shard_tenant.alias("tenant"), wd.alias("wd"), site.alias("site"))
    plain = F.struct(name(tenant), ats.alias("ats"), tenant.alias("tenant"), none.alias("wd"), none.alias("site"))
    return F.when(or_empty(url) == "", None).when(shard_tenant != "", F.when(site != "", sharded)).when(ats.isin(*K.SUPPORTED) & (tenant != ""), plain)


def known_host(url: Column) -> Column:
    """The board software of a host, modelled or not; null for other hosts."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in K.URL_HOSTS.items() for x in pair)), _netloc(url))


def board_slugs(url: Column) -> Column:
    """The first host label, and on hosts that carry it there the first path segment."""
    shaped = F.regexp_extract(F.trim(or_empty(url)), r"^https?://([^/?#]+)", 1)
    host = F.lower(shaped)
    first = F.get(segments_of(F.trim(or_empty(url))), 0)
    in_path = host.rlike("(" + "|".join(h.replace(".", r"\.") for h in K.TENANT_IN_PATH) + ")$")
    slugs = F.array_compact(F.array(F.element_at(F.split(host, r"\.", 2), 1), F.when(in_path, first)))
    return F.when(shaped != "", slugs).otherwise(F.array().cast("array<string>"))
