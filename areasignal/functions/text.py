"""Phrases, segments, captions and prompts as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from areasignal.functions.geo import named

# The texts of a segment without evidence.
NO_EVIDENCE = {"sat": "[no satellite evidence]", "ntl": "[no nightlight evidence]", "sv": "[no streetview evidence]", "poi": "(no POI recorded)"}
# Keywords of each group of street phrases.
STREET_GROUPS: dict[str, tuple[str, ...]] = {
    "sidewalk": ("pavement", "sidewalk", "curb", "path", "walkway"),
    "building": ("facade", "building", "buildings", "house", "houses", "apartment", "apartments", "roof", "roofs", "window", "windows", "balconies", "garage", "porch"),
    "road": ("road", "asphalt", "driveway", "lane", "parking", "curb", "crossing"),
    "greenery": ("tree", "trees", "grass", "grassy", "bush", "bushes", "shrub", "shrubs", "hedge", "hedges", "lawn", "lawns", "flower", "flowers", "foliage"),
    "street_furniture": ("lamp", "lamppost", "streetlight", "streetlights", "bin", "bins", "sign", "signage", "fence", "rail", "railing", "pole", "mailbox", "barrier"),
    "mobility": ("car", "cars", "vehicle", "vehicles", "van", "bus", "bike", "bikes", "person", "people", "pedestrian", "pedestrians", "traffic"),
    "condition": ("crack", "cracks", "worn", "wear", "uneven", "smooth", "clean", "debris", "graffiti", "stain", "stains", "puddle", "repair", "overgrown"),
    "activity": ("shop", "shops", "store", "storefront", "frontage", "commercial", "industrial", "warehouse", "vacant", "sign", "bus shelter"),
}
# Place types and their categories.
CATEGORY_OF = {
    "restaurant": "food_drink",
    "cafe": "food_drink",
    "bar": "food_drink",
    "bakery": "food_drink",
    "meal_takeaway": "food_drink",
    "meal_delivery": "food_drink",
    "food": "food_drink",
    "night_club": "food_drink",
    "supermarket": "retail",
    "grocery_or_supermarket": "retail",
    "convenience_store": "retail",
    "shopping_mall": "retail",
    "clothing_store": "retail",
    "book_store": "retail",
    "home_goods_store": "retail",
    "hardware_store": "retail",
    "shoe_store": "retail",
    "electronics_store": "retail",
    "department_store": "retail",
    "bicycle_store": "retail",
    "florist": "retail",
    "jewelry_store": "retail",
    "liquor_store": "retail",
    "furniture_store": "retail",
    "pet_store": "retail",
    "store": "retail",
    "hospital": "health",
    "pharmacy": "health",
    "doctor": "health",
    "dentist": "health",
    "physiotherapist": "health",
    "health": "health",
    "veterinary_care": "health",
    "school": "education",
    "primary_school": "education",
    "secondary_school": "education",
    "university": "education",
    "library": "education",
    "bank": "finance",
    "atm": "finance",
    "insurance_agency": "finance",
    "accounting": "finance",
    "bus_station": "transport",
    "subway_station": "transport",
    "train_station": "transport",
    "transit_station": "transport",
    "taxi_stand": "transport",
    "light_rail_station": "transport",
    "park": "leisure",
    "gym": "leisure",
    "stadium": "leisure",
    "sports_complex": "leisure",
    "movie_theater": "leisure",
    "casino": "leisure",
    "amusement_park": "leisure",
    "bowling_alley": "leisure",
    "spa": "leisure",
    "swimming_pool": "leisure",
    "golf_course": "leisure",
    "post_office": "services",
    "police": "services",
    "local_government_office": "services",
    "fire_station": "services",
    "embassy": "services",
    "courthouse": "services",
    "city_hall": "services",
    "place_of_worship": "services",
    "tourist_attraction": "tourism",
    "museum": "tourism",
    "lodging": "tourism",
    "hotel": "tourism",
    "art_gallery": "tourism",
    "zoo": "tourism",
    "aquarium": "tourism",
}
# The order in which a caption takes the groups, the names of counted types, its sentences.
CAPTION_GROUPS = ("road", "building", "sidewalk", "greenery", "street_furniture", "mobility", "condition", "activity")
POI_LABELS = {"public_transport": "public transport", "shop": "retail", "amenity": "amenity", "healthcare": "healthcare", "railway": "railway", "office": "office", "tourism": "tourism"}
SENTENCES = {
    "sat": ("Satellite imagery suggests ", "a mixed urban form with limited explicit cues"),
    "ntl": ("Nighttime light patterns show ", "weak and spatially fragmented illumination"),
    "sv": ("Across the street-view images, recurring elements include ", "mixed street conditions and low-rise built forms"),
    "other": ("Local variation is also visible through ", ""),
    "poi": ("The POI summary indicates ", ""),
    "end": ("Taken together, the modalities describe the built form, open-space pattern, lighting distribution, street-level maintenance cues, and local service context of this area.", ""),
}


def phrase_key(phrase: Column) -> Column:
    """What phrases are alike by: trimmed and lower-cased."""
    return F.lower(F.trim(phrase))


def tidy(phrase: Column) -> Column:
    """Underscores as spaces, white space made one space, trimmed."""
    return F.trim(F.regexp_replace(F.replace(phrase, F.lit("_"), F.lit(" ")), r"(?U)\s+", " "))


def distinct_phrases(phrases: Column) -> Column:
    """The first of phrases alike, trimmed, in order; empty and null ones go. For lists of one record."""
    kept = F.filter(phrases, lambda p: F.coalesce(phrase_key(p), F.lit("")) != "")
    first = lambda kept, keys: F.filter(kept, lambda p, i: F.array_position(keys, F.get(keys, i)) == i + 1)
    distinct = named(kept, lambda k: named(F.transform(k, phrase_key), lambda keys: first(k, keys)))  # once, not once a phrase
    return F.transform(distinct, lambda p: F.trim(p))


def segment(phrases: Column, marker: str, most: int | None = None, distinct: bool = False) -> Column:
    """Distinct phrases joined by "; ", at most `most` of them; the marker if there are none. distinct: they are already."""
    kept = phrases if distinct else distinct_phrases(phrases)
    return F.coalesce(F.nullif(F.array_join(F.slice(kept, 1, most) if most else kept, "; "), F.lit("")), F.lit(marker))


def split_segment(text: Column) -> Column:
    """The phrases of a segment; none of a null, empty or marker text."""
    none = F.coalesce(F.trim(text).isin(*[NO_EVIDENCE[k] for k in ("sat", "ntl", "sv")]), F.lit(True))
    return F.when(none, F.array().cast("array<string>")).otherwise(F.filter(F.transform(F.split(text, ";"), lambda p: F.trim(p)), lambda p: p != ""))


def tagged(sat: Column, ntl: Column, sv: Column, poi: Column) -> Column:
    """The four segments in one text, each after its tag."""
    return F.format_string("[SAT] %s [NTL] %s [SV] %s [POI] %s", sat, ntl, sv, poi)


def keyword_pattern(words: Sequence[str]) -> str:
    return r"(?i)\b(?:" + "|".join(words) + r")\b"


def groups_of(phrase: Column, groups: Mapping[str, Sequence[str]] = STREET_GROUPS) -> Column:
    """Names of all groups with a keyword in the phrase, or `other` alone."""
    found = F.filter(F.array(*(F.when(phrase.rlike(keyword_pattern(w)), F.lit(g)) for g, w in groups.items())), lambda g: g.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("other")))


def top_phrases(phrases: Column, most: int) -> Column:
    """The most frequent phrases of a list, ties by key, each as it was spelled first."""
    tidied = F.filter(F.transform(phrases, tidy), lambda p: F.coalesce(p, F.lit("")) != "")
    keys = F.transform(tidied, F.lower)
    ranked = F.transform(F.array_distinct(keys), lambda k: F.struct((-F.size(F.filter(keys, lambda x: x == k))).alias("n"), k.alias("k"), F.element_at(tidied, F.array_position(keys, k).cast("int")).alias("p")))
    return F.transform(F.slice(F.array_sort(ranked), 1, most), lambda r: r["p"])


def sentence(prefix: str, phrases: Column) -> Column:
    """Prefix and distinct phrases in lower case as "a, b, and c."; empty without phrases."""

    def said(p: Column) -> Column:
        n = F.size(p)
        body = F.when(n == 1, F.get(p, F.lit(0))).otherwise(F.concat(F.array_join(F.slice(p, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(", and "), F.get(p, n - 1)))
        return F.when(n == 0, F.lit("")).otherwise(F.concat(F.lit(prefix), body, F.lit(".")))

    return named(F.transform(distinct_phrases(phrases), F.lower), said)


def poi_phrases(counts: Column) -> Column:
    """What a map of counts by type says; a null, empty or zero map has its own phrase."""
    total = F.coalesce(F.aggregate(F.map_values(counts), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0))), F.lit(0).cast("long"))
    named = F.filter(F.array(*(F.when(F.try_element_at(counts, F.lit(k)) > 0, F.concat_ws(" ", F.try_element_at(counts, F.lit(k)).cast("string"), F.lit(f"{label} entries"))) for k, label in POI_LABELS.items())), lambda p: p.isNotNull())
    return F.when(total == 0, F.array(F.lit("no listed POI entries"))).when(F.size(named) > 0, named).otherwise(F.array(F.concat_ws(" ", total.cast("string"), F.lit("total POI entries"))))


def evidence_block(sat: Column, ntl: Column, street: Column, poi: Column, general: Column | None = None, images: int = 6) -> Column:
    """Evidence as a prompt has it: a line for each source that says something, joined by "; ".

    street is an array of structs key and phrases, shown in the order of the keys, the first `images` of them; a note says how
    many more there are. poi may be text or an array. Null and empty phrases are left out.
    """
    body = lambda x: F.nullif(F.array_join(F.filter(x, lambda p: F.coalesce(p, F.lit("")) != ""), "; "), F.lit(""))
    line = lambda name, x: F.array(F.concat(name, F.lit(": "), body(x)))
    ordered = F.array_sort(street)
    shown = F.transform(F.slice(ordered, 1, images), lambda s: F.concat(s["key"], F.lit(": "), body(s["phrases"])))
    left = F.size(street) - images
    note = F.array(F.when(left > 0, F.format_string("(+%d more streetviews omitted)", left)))
    said = [line(F.lit("satellite"), sat), line(F.lit("nightlight"), ntl), shown, note, line(F.lit("POI"), poi)]
    said += [line(F.lit("general"), general)] if general is not None else []
    return F.array_join(F.filter(F.concat(*said), lambda x: x.isNotNull()), "\n")


def poi_block(summary: Column) -> Column:
    """What a prompt says of counts."""
    return F.when(F.coalesce(summary, F.lit("")) == "", F.lit("POI data: none available.")).otherwise(F.concat(F.lit("POI data (tabular summary):\n"), summary))


def image_order(n: Column) -> Column:
    """The line of a prompt that names the images in their order, n of them from the street."""
    keys = F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.format_string("streetview_%02d", i))
    return F.concat(F.lit("Image order (must match JSON keys): "), F.array_join(F.concat(F.array(F.lit("satellite"), F.lit("nightlight")), keys), ", "), F.lit("."))


def indicator_prompt(task: str, block: Column, spec: Mapping[str, str], poi: Column | None = None, minimal: bool = False) -> Column:
    """A prompt that asks for scores from text alone: the task, the evidence (with a line of counts if it has none), and each
    indicator with what to look at; minimal: the names alone."""
    evidence = block if poi is None else F.when(block.contains("POI:") | (F.coalesce(poi, F.lit("")) == ""), block).otherwise(F.concat(block, F.lit("\nPOI: "), poi))
    listed = "\n".join(f"- {k}" if minimal else f"- {k}: {v}" for k, v in spec.items())
    return F.concat(F.lit(f"{task}\n\nEvidence for this datazone:\n"), evidence, F.lit(f"\n\nIndicators to score (in this order):\n{listed}\n\nReturn one JSON object with all {len(spec)} of them, each with a score from 0 to 4."))


def chat(system: str, prompt: Column, images: Column) -> Column:
    """Messages of a model's call: role, text and images (paths, in their order)."""
    none = F.array().cast("array<string>")
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("text"), none.alias("images")), F.struct(F.lit("user").alias("role"), prompt.alias("text"), images.alias("images")))


def poi_summary(counts: Column) -> Column:
    """ "N POIs total: a ×n, b ×m" by falling count, ties by name; the marker if there is nothing."""
    kept = F.filter(F.map_entries(counts), lambda e: e["value"] > 0)
    total = F.aggregate(kept, F.lit(0).cast("long"), lambda a, e: a + e["value"])
    order = F.array_sort(F.transform(kept, lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("k"))))
    body = F.array_join(F.transform(order, lambda e: F.concat(e["k"], F.lit(" ×"), (-e["n"]).cast("string"))), ", ")
    return F.when(F.coalesce(total, F.lit(0)) == 0, F.lit(NO_EVIDENCE["poi"])).otherwise(F.concat(total.cast("string"), F.lit(" POIs total: "), body))


def parsed_counts(text: Column) -> Column:
    """Type to count of a summary; of a type named twice the last count."""
    name, n = (F.regexp_extract_all(text, F.lit(r"(?U)(\w+)\s*[×x]\s*(\d+)"), F.lit(g)) for g in (1, 2))
    last = F.filter(F.arrays_zip(name.alias("k"), F.transform(n, lambda x: x.try_cast("long")).alias("v")), lambda e, i: F.forall(F.slice(name, i + 2, F.greatest(F.size(name) - i - 1, F.lit(0))), lambda x: x != e["k"]))
    none = F.coalesce(text, F.lit("")).contains(NO_EVIDENCE["poi"])
    return F.when(none | text.isNull(), F.create_map().cast("map<string,bigint>")).otherwise(F.map_from_entries(last))


def parsed_total(text: Column) -> Column:
    """The leading total of a summary, or else the sum of its counts."""
    said = F.nullif(F.regexp_extract(text, r"^(\d+)\s+POIs? total", 1), F.lit("")).try_cast("long")
    return F.when(F.coalesce(text, F.lit("")).contains(NO_EVIDENCE["poi"]) | text.isNull(), F.lit(0).cast("long")).otherwise(F.coalesce(said, F.aggregate(F.map_values(parsed_counts(text)), F.lit(0).cast("long"), lambda a, x: a + x)))


def first_known(names: Column, table: Mapping[str, str], default: str = "other") -> Column:
    """The value of the first name that the table has."""
    known = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.coalesce(F.get(F.filter(F.transform(names, lambda t: F.try_element_at(known, t)), lambda c: c.isNotNull()), F.lit(0)), F.lit(default))


def level(quintile: Column) -> Column:
    """high for quintiles 1 and 2, low above, unknown if null."""
    return F.when(quintile.isNull(), "unknown").when(quintile <= 2, "high").otherwise("low")


def code(text: Column) -> Column:
    """A trimmed code; null for an empty one or nan."""
    t = F.trim(text)
    return F.when((t == "") | (F.lower(t) == "nan"), None).otherwise(t)


def whole(text: Column) -> Column:
    """An integer from text that may be a decimal; null if it isn't a number."""
    return text.try_cast("double").try_cast("bigint")


def sample_key(fmt: str, *parts: Column) -> Column:
    """A composite key such as %s_%04d."""
    return F.format_string(fmt, *parts)


def run_name(path: Column) -> Column:
    """The folder that a file of results lies in."""
    return F.regexp_extract(path, r"([^/\\]+)[/\\][^/\\]*$", 1)


def anchored(path: Column, root: str, markers: Sequence[str] = ("dataset/", "outputs/")) -> Column:
    """A path of another machine from the first marker that it has, under a root of this one; without any as it is."""
    found = [F.when(F.locate(m, path) > 0, F.concat(F.lit(root.rstrip("/") + "/"), F.substring(path, F.locate(m, path), F.length(path)))) for m in markers]
    return F.coalesce(*found, path)


def iso_utc(time: Column) -> Column:
    """A time of the session's zone as UTC in ISO 8601."""
    return F.date_format(F.to_utc_timestamp(time, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
