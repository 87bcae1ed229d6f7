"""Faceted exploration: query parameters, filter, live counts, value order.

Every facet is an array of (value, label) of an item, so a filter is membership and a count is one explode."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import text
from lumenframe.operators import items as it

FACETS = ("decade", "year", "director", "genre", "country", "language", "collection", "list", "resolution", "subs", "location", "state")
ORDERS = ("year", "title", "added", "size", "list-added")
STATES = ("unidentified", "several-versions", "identical-copy")
#: The Spanish names of facets and orders are accepted as well.
ALIASES = {"decada": "decade", "anio": "year", "genero": "genre", "pais": "country", "idioma": "language", "coleccion": "collection", "lista": "list", "resolucion": "resolution", "ubicacion": "location", "estado": "state", "titulo": "title", "agregado": "added", "tamano": "size", "agregado-lista": "list-added"}
STATE_ALIASES = {"sin-identificar": "unidentified", "varias-versiones": "several-versions", "copia-identica": "identical-copy"}

_NUMBER, _CODE = re.compile(r"[1-9]\d{0,9}"), re.compile(r"[a-z]{2,3}")


def valid(facet: str, value: str) -> bool:
    """Whether a parameter's value can be one of the facet."""
    if facet in ("year", "director", "collection", "list"):
        return bool(_NUMBER.fullmatch(value))
    if facet == "decade":
        return bool(_NUMBER.fullmatch(value)) and value.endswith("0")
    if facet == "country":
        return bool(re.fullmatch("[A-Z]{2}", value))
    if facet in ("language", "subs"):
        return bool(_CODE.fullmatch(value))
    if facet == "resolution":
        return value in ("4K", "1080p", "720p", "SD")
    if facet == "state":
        return value in STATES
    return facet in FACETS and bool(value.strip())


@dataclass(frozen=True)
class Query:
    facets: dict[str, str] = field(default_factory=dict)
    order: str = "year"
    direction: str = "desc"

    @classmethod
    def from_params(cls, params: dict[str, str]) -> Query:
        """From request parameters; what isn't valid is dropped. With a list, the order by its dates is the default and needs no asking."""
        p = {ALIASES.get(k, k): v for k, v in params.items()}
        facets = {}
        for f in FACETS:
            v = p.get(f, "")
            v = STATE_ALIASES.get(v, v) if f == "state" else v
            if v and valid(f, v):
                facets[f] = v
        order = ALIASES.get(p.get("order", p.get("orden", "")), p.get("order", p.get("orden", "")))
        if order not in ORDERS[:-1]:
            order = "list-added" if "list" in facets else "year"
        direction = p.get("dir", "")
        return cls(facets, order, direction if direction in ("asc", "desc") else "asc" if order == "title" else "desc")

    def without_missing_list(self, lists: DataFrame) -> Query:
        """The list facet and its order go if the list is gone."""
        if "list" not in self.facets or not lists.where(F.col("id") == int(self.facets["list"])).isEmpty():
            return self
        rest = {k: v for k, v in self.facets.items() if k != "list"}
        return Query(rest, "year", "desc") if self.order == "list-added" else Query(rest, self.order, self.direction)


def values(facet: str):
    """array(struct(value, label)) of an item's facet. Directors without an id are left out."""
    pair = lambda v, label=None: F.struct(v.cast("string").alias("value"), (v if label is None else label).cast("string").alias("label"))
    none = F.expr("cast(array() as array<struct<value:string,label:string>>)")
    one = lambda cond, v, label=None: F.when(cond, F.array(pair(v, label))).otherwise(none)
    each = lambda c, get=lambda x: x, label=None: F.transform(F.col(c), lambda x: pair(get(x), label(x) if label else None))
    return {
        "decade": lambda: one(F.col("year") > 0, F.expr("year div 10 * 10"), F.concat(F.expr("cast(year div 10 * 10 as string)"), F.lit("s"))),
        "year": lambda: one(F.col("year") > 0, F.col("year")), "director": lambda: F.transform(F.filter("directors", lambda d: d["id"] > 0), lambda d: pair(d["id"], d["name"])),
        "genre": lambda: each("genres"), "country": lambda: F.when(F.col("movie_id") > 0, each("countries")).otherwise(none), "language": lambda: one(F.col("original_lang") != "", F.col("original_lang")),
        "collection": lambda: one(F.col("collection_id") > 0, F.col("collection_id"), F.col("collection")), "list": lambda: each("lists", lambda x: x["id"], lambda x: x["name"]),
        "resolution": lambda: each("resolutions"), "subs": lambda: each("subs"), "location": lambda: each("locations"), "state": lambda: each("states"),
    }[facet]()


def tagged(facet: str, name: str):
    """values() with the facet's own name in a field ``name``. A function of its own: a lambda's second parameter would be the index."""
    return F.transform(values(facet), lambda x: F.struct(F.lit(facet).alias(name), x["value"].alias("value"), x["label"].alias("label")))


def matches(facet: str, value: str):
    return F.exists(values(facet), lambda x: x["value"] == value)


def filtered(items: DataFrame, facets: dict[str, str]) -> DataFrame:
    out = items
    for f, v in facets.items():
        out = out.where(matches(f, v))
    return out


def counts(items: DataFrame, facets: dict[str, str], only: tuple[str, ...] = FACETS) -> DataFrame:
    """facet, value, label, n, rank: items with each value among those that match all other facets, in one pass.

    An item counts for facet F if nothing else fails: no facet, or F alone. The decade also leaves the year out.
    Repeated values of an item count each time."""
    fails = {f: F.when(matches(f, v), 0).otherwise(1) for f, v in facets.items()}
    rows = items.withColumns({f"_x_{f}": x for f, x in fails.items()})
    total = sum((F.col(f"_x_{f}") for f in fails), F.lit(0))
    branches = []
    for f in only:
        own = (F.col(f"_x_{f}") if f in fails else F.lit(0)) + (F.col("_x_year") if f == "decade" and "year" in fails else F.lit(0))
        pairs = tagged(f, "facet")
        branches.append(F.when(total - own == 0, pairs).otherwise(F.expr("cast(array() as array<struct<facet:string,value:string,label:string>>)")))
    each = rows.select(F.explode(F.flatten(F.array(*branches))).alias("p")).select("p.*")
    out = each.groupBy("facet", "value").agg(F.count("*").alias("n"), F.min("label").alias("label"))
    return with_rank(out)


def with_rank(counted: DataFrame) -> DataFrame:
    """rank of a value in its facet: years and decades from the latest, places by name, others by count; label and value break ties."""
    from pyspark.sql import Window

    late = F.when(F.col("facet").isin("decade", "year"), -F.col("value").try_cast("long"))
    place = F.when(F.col("facet") == "location", F.col("value"))
    often = F.when(~F.col("facet").isin("decade", "year", "location"), -F.col("n"))
    w = Window.partitionBy("facet").orderBy(late, place, often, "label", "value")
    return counted.withColumn("rank", F.row_number().over(w))


def explore(items: DataFrame, query: Query) -> tuple[DataFrame, DataFrame]:
    """(items that match, sorted; counts of all facets)."""
    list_id = int(query.facets["list"]) if "list" in query.facets else None
    return it.sort(filtered(items, query.facets), query.order, query.direction, list_id), counts(items, query.facets)


def menu(counted: DataFrame, facet: str, typed: str) -> DataFrame:
    """A facet's values whose label contains what is typed."""
    return counted.where((F.col("facet") == facet) & F.contains(F.lower("label"), F.lit(typed.lower()))).orderBy("rank")


def years_of(counted: DataFrame, decade: str) -> DataFrame:
    return counted.where((F.col("facet") == "year") & F.col("value").startswith(decade[:3])).orderBy("rank")


def match_lists(lists: DataFrame, q: str) -> DataFrame:
    return lists.where(F.contains(text.fold("name"), text.fold(F.lit(q))))


def match_versions(view: DataFrame, q: str, own: str, limit: int = 20) -> DataFrame:
    """Versions that another may be a part of: hashed, not itself, title or folder containing q."""
    hit = F.contains(text.fold("title"), text.fold(F.lit(q))) | F.contains(text.fold("dir"), text.fold(F.lit(q)))
    return view.where((F.col("fingerprint") != "") & (F.col("fingerprint") != own) & hit).orderBy(text.ascii_lower("title"), "year", "id").limit(limit)
