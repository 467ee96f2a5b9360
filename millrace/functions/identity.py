"""The identity of a record: its name key, its link reference and its tokens."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace import fixed_values as fv
from millrace.functions.text import bind, long_numbers, plain_name, present, strip

# RFC 3986, appendix B: scheme, authority, path, query.
URL_PARTS = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def name_key(company: Column, title: Column, ignored: Iterable[str]) -> Column:
    ignored = list(ignored)
    return F.concat_ws("|", plain_name(company, ignored), plain_name(title, ignored))


def _decoded(piece: Column) -> Column:
    """Form-decode; a percent sign that starts no escape stands for itself."""
    return F.try_url_decode(F.regexp_replace(piece, "%(?![0-9A-Fa-f]{2})", "%25"))


def link_reference(link: Column) -> Column:
    """Stable identity of a link, or NULL where it has none.

    A query without any posting parameter marks a redirect, whose path is shared
    by unrelated records, so such links have no identity.
    """
    def parts(url: Column) -> Column:
        names = ["scheme", "authority", "path", "query"]
        return F.struct(*[F.regexp_extract(url, URL_PARTS, n + 1).alias(name)
                          for n, name in enumerate(names)])

    def reference(url: Column) -> Column:
        base = F.concat(F.lower(url["authority"]), F.regexp_replace(url["path"], "/+$", ""))
        known = bind(_posting_pairs(url["query"]),
                     lambda ids: F.when(ids != "", F.concat(base, F.lit("?"), ids)))
        return (F.when(~F.startswith(F.lower(url["scheme"]), F.lit("http")), F.lit(None))
                .when(url["authority"] == "", F.lit(None))
                .when(url["query"] == "", base).otherwise(known))

    cleaned = F.translate(strip(link), "\t\r\n", "")
    return F.when(F.length(link) > 0, bind(parts(cleaned), reference))


def _posting_pairs(query: Column) -> Column:
    """The sorted name=value pairs of a query that identify a posting, joined by `&`."""
    filled = F.filter(F.split(query, "&"), lambda p: p.rlike(r"(?s)^[^=]*=.+"))
    pairs = F.array_sort(F.transform(filled, lambda p: F.struct(
        _decoded(F.substring_index(p, "=", 1)).alias("name"),
        _decoded(F.regexp_replace(p, r"(?s)\A[^=]*=", "")).alias("value"))))
    naming = F.filter(pairs, lambda p: p["name"].rlike("(?iu)" + fv.POSTING_PARAMETER))
    return F.array_join(
        F.transform(naming, lambda p: F.concat(F.lower(p["name"]), F.lit("="), p["value"])), "&")


def with_identity(records: DataFrame, ignored: Iterable[str]) -> DataFrame:
    """Add name_key, link_ref and tokens.

    Two records conflict when they share any token: `K` the name key, `L` the link
    reference, `T` the plain title with one long number from link or notes.
    """
    ignored = list(ignored)
    keyed = records.withColumns({
        "plain_title": plain_name(F.col("title"), ignored),
        "name_key": name_key(F.col("company"), F.col("title"), ignored),
        "link_ref": link_reference(F.col("link"))})
    by_title = F.transform(long_numbers(F.col("link"), F.col("notes")), lambda n: F.concat(
        F.lit("T:"), F.col("plain_title"), F.lit("|"), n))
    by_name = F.array(F.concat(F.lit("K:"), "name_key"), F.concat(F.lit("L:"), "link_ref"))
    return keyed.withColumn(
        "tokens", F.array_sort(F.array_compact(F.concat(by_name, by_title)))).drop("plain_title")


def each_token(records: DataFrame, ignored: Iterable[str], *columns: str) -> DataFrame:
    """A row (columns, token) per token of each record.

    No record is without tokens, so explode_outer gives what explode does. Before an explode Spark tests for empty
    lists, and for that test it would make all tokens once more.
    """
    return with_identity(records, ignored).select(*columns, F.explode_outer("tokens").alias("token"))


def valid_link(link: Column) -> Column:
    return F.startswith(strip(present(link)), F.lit("http"))
