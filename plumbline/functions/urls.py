"""URL scalars, as regular expressions so that they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.once import once

#: Parameters that only track where a visitor came from.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "msclkid")


def normalize_url(u: Column) -> Column:
    """Scheme, host and path in lower case, without www., query, fragment and closing slashes."""
    bare = F.regexp_replace(F.coalesce(u, F.lit("")), r"[?#].*$", "")
    return F.lower(F.regexp_replace(F.regexp_replace(bare, "/+$", ""), "://www[.]", "://"))


def is_valid_url(u: Column) -> Column:
    return F.coalesce(u, F.lit("")).rlike(r"(?i)^https?://[^\s/$.?#].[^\s]*$")


def _rest(u: Column) -> Column:
    """What follows the scheme, without the fragment; null where there is no scheme with two slashes."""
    return F.when(u.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), F.substring_index(F.substr(u, F.locate("://", u) + 3), "#", 1))


def _authority(u: Column) -> Column:
    """The host as written, lower-cased, with its port, without www."""
    net = F.lower(F.substring_index(F.substring_index(_rest(u), "/", 1), "?", 1))
    return F.when(net.startswith("www."), F.substr(net, F.lit(5))).otherwise(net)


def domain(u: Column) -> Column:
    """Lower case, no www., the port kept; null for what is no URL."""
    return F.when(is_valid_url(u), _authority(u))


def host(u: Column) -> Column:
    """Lower case, no www., no port; null for what is no URL."""
    return F.substring_index(domain(u), ":", 1)


def root_domain(u: Column) -> Column:
    """The last two labels of the domain, with its port."""
    return F.substring_index(domain(u), ".", -2)


def _decoded(x: Column) -> Column:
    return F.coalesce(F.try_url_decode(x), x)


def _encoded(x: Column) -> Column:
    """As forms encode: letters, digits and _.-~ stay, a space becomes a plus sign."""
    return F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


#: A query of these characters alone, without = in values, is the same decoded and encoded.
PLAIN_QUERY = r"^[A-Za-z0-9_.~=&-]*$"


def dedupe_key(u: Column) -> Column:
    """https, bare host, path, and the parameters with values that do not track, by name, encoded anew.

    What has no scheme is taken for a path; null and empty texts have no key.
    Each piece of a URL is worked out once, and only parameters with other than
    plain characters are decoded and encoded.
    """

    def cut(x: Column) -> Column:
        scheme = x.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://")
        return F.struct(scheme.alias("scheme"), F.substring_index(F.when(scheme, F.substr(x, F.locate("://", x) + 3)).otherwise(x), "#", 1).alias("rest"))

    def parted(x: Column) -> Column:
        where = F.substring_index(x["rest"], "?", 1)
        return F.struct(where.alias("where"), F.when(x["scheme"], F.substring_index(where, "/", 1)).otherwise("").alias("net"), F.substr(x["rest"], F.length(where) + 2).alias("query"))

    def joined(x: Column) -> Column:
        net = F.lower(x["net"])
        bare = F.substring_index(F.when(net.startswith("www."), F.substr(net, F.lit(5))).otherwise(net), ":", 1)
        path = F.rtrim(F.substr(x["where"], F.length(x["net"]) + 1), F.lit("/"))
        start = F.concat(F.lit("https://"), bare, F.when(path == "", F.lit("/")).otherwise(path))
        return F.when(x["query"] == "", start).otherwise(once(parameters(x["query"]), lambda q: F.when(q != "", F.concat(start, F.lit("?"), q)).otherwise(start)))

    def parameters(query: Column) -> Column:
        names = F.array(*[F.lit(t) for t in TRACKING])
        # a value that is a sign of equality, as in a==, counts
        pairs = F.filter(F.split(query, "&"), lambda p: p.contains("=") & ~p.endswith("=") | p.rlike("=.*="))

        def listed(read, write) -> Column:
            named = F.transform(pairs, lambda p, i: F.struct(read(F.substring_index(p, "=", 1)).alias("n"), i.alias("i"), read(F.substr(p, F.locate("=", p) + 1)).alias("v")))
            kept = F.filter(named, lambda x: ~F.array_contains(names, x["n"]) & (x["v"] != ""))
            return F.array_join(F.transform(F.array_sort(kept), lambda x: F.concat(write(x["n"]), F.lit("="), write(x["v"]))), "&")

        def sorted_pairs(left: Column) -> Column:
            parts = F.transform(F.split(left, "&"), lambda p, i: F.struct(F.substring_index(p, "=", 1).alias("n"), i.alias("i"), p.alias("p")))
            return F.when(F.contains(left, F.lit("&")), F.array_join(F.transform(F.array_sort(parts), lambda x: x["p"]), "&")).otherwise(left)

        simple = query.rlike(PLAIN_QUERY) & ~query.rlike("=[^&]*=")
        left = F.substr(F.regexp_replace(F.concat(F.lit("&"), query), rf"&(?:(?:{'|'.join(TRACKING)})=[^&]*|[^&=]*=?)(?=&|$)", ""), F.lit(2))
        return F.when(simple, once(left, sorted_pairs)).otherwise(listed(_decoded, _encoded))

    return F.when(u != "", once(once(once(u, cut), parted), joined))


def domain_in(u: Column, domains: list[str]) -> Column:
    """The domain, or its last two labels, are those of one of the listed ones."""
    listed = [d.lower().replace("www.", "") for d in domains]
    roots = [".".join(d.split(".")[-2:]) for d in listed]
    return F.coalesce(domain(u).isin(listed) | root_domain(u).isin(roots), F.lit(False))
