"""Credit lines, titles, query words, citations and other text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from observatory.functions.names import literal_map

# Licence codes and their printed names, reuse rules.
LICENSE_NAMES = {
    "cc0": "CC0 1.0",
    "cc-by": "CC BY 4.0",
    "cc-by-nc": "CC BY-NC 4.0",
    "cc-by-sa": "CC BY-SA 4.0",
    "cc-by-nd": "CC BY-ND 4.0",
    "cc-by-nc-sa": "CC BY-NC-SA 4.0",
    "cc-by-nc-nd": "CC BY-NC-ND 4.0",
}
DISPLAYABLE = {
    "cc0": "CC0",
    "cc-by": "CC BY",
    "cc-by-sa": "CC BY-SA",
    "cc-by-nc": "CC BY-NC",
    "cc-by-nc-sa": "CC BY-NC-SA",
}
REUSABLE_PREFIXES = ("public domain", "pd", "cc0", "cc by")
ARTIST_MAX = 80


def license_name(code: Column) -> Column:
    code = F.nullif(code, F.lit(""))
    return F.coalesce(F.try_element_at(literal_map(LICENSE_NAMES), code), code, F.lit("all rights reserved"))


def display_license(code: Column) -> Column:
    """Printed licence of a photo that may be shown, else null."""
    return F.try_element_at(literal_map(DISPLAYABLE), code)


def strip_html(text: Column) -> Column:
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"<[^>]+>", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def is_reusable(short_name: Column) -> Column:
    low = F.lower(strip_html(short_name))
    out = F.lit(False)
    for prefix in REUSABLE_PREFIXES:
        out = out | low.startswith(prefix)
    return out & (F.length(low) > 0)


def credit(short_name: Column, license_url: Column, artist: Column) -> Column:
    """Credit struct when the licence allows reuse, else null."""
    who = strip_html(artist)
    cut = F.concat(F.left(who, F.lit(ARTIST_MAX - 1)), F.lit("…"))
    return F.when(
        is_reusable(short_name),
        F.struct(
            strip_html(short_name).alias("license"),
            strip_html(license_url).alias("license_url"),
            F.when(F.length(who) > ARTIST_MAX, cut)
            .when(F.length(who) > 0, who)
            .otherwise("unknown")
            .alias("artist"),
        ),
    )


# Accented Latin letters folded to ASCII for slugs.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def slug(name: Column) -> Column:
    """Lower-case key: accents folded, other non-ASCII dropped, runs to ``_``."""
    folded = F.translate(F.lower(name), ACCENTED, PLAIN)
    ascii_only = F.regexp_replace(folded, r"[^\x00-\x7F]", "")
    return F.trim(F.regexp_replace(ascii_only, r"[^a-z0-9]+", "_"), F.lit("_"))


def short_park(name: Column) -> Column:
    out = F.regexp_replace(name, r" National Park( and Preserve)?$", "")
    out = F.regexp_replace(out, r" National Parks$", "")
    return F.regexp_replace(out, r"^National Park of ", "")


WIKI = "https://en.wikipedia.org/wiki/"


def wiki_url(tag: Column) -> Column:
    """``en:Some Title`` to its article; other languages give null."""
    title = F.replace(tag.substr(F.lit(4), F.length(tag)), F.lit(" "), F.lit("_"))
    return F.when(tag.startswith("en:"), F.concat(F.lit(WIKI), title))


def wiki_title(url: Column) -> Column:
    """Article title of a page address, spaces restored, null when there is none."""
    tail = F.get(F.split(url, "/wiki/"), F.lit(1))
    return F.nullif(F.replace(F.url_decode(F.replace(tail, F.lit("+"), F.lit("%2B"))), F.lit("_"), F.lit(" ")), F.lit(""))


# The two photo hosts and the photo address pattern.
PHOTO_HOSTS = (
    "https://inaturalist-open-data.s3.amazonaws.com/photos/",
    "https://static.inaturalist.org/photos/",
)
PHOTO_PATTERN = r"^(https://[^/]+/photos/)(\d+)/[a-z_]+\.([A-Za-z0-9]+)$"


def parse_photo(url: Column) -> Column:
    """``struct<photo_id,ext,host>`` of a known photo address, else null."""
    host = F.regexp_extract(url, PHOTO_PATTERN, 1)
    index = F.array_position(F.array(*[F.lit(h) for h in PHOTO_HOSTS]), host)
    return F.when(
        index > 0,
        F.struct(
            F.regexp_extract(url, PHOTO_PATTERN, 2).try_cast("bigint").alias("photo_id"),
            F.lower(F.regexp_extract(url, PHOTO_PATTERN, 3)).alias("ext"),
            (index - 1).cast("int").alias("host"),
        ),
    )


def number_or_null(text: Column) -> Column:
    return text.try_cast("double")


ELEVATION_FLOOR_M = -500.0


def parse_elevation(body: Column) -> Column:
    """Elevation in a JSON body; junk, missing and sentinel values give null."""
    value = F.get_json_object(F.when(F.try_parse_json(body).isNotNull(), body), "$.value").try_cast("double")
    return F.when((value >= ELEVATION_FLOOR_M) & (value < float("inf")), value)


# Small words kept low in station names.
SMALL_WORDS = ("at", "near", "of", "the", "and", "nr", "blw", "abv")


def title_case(text: Column) -> Column:
    """Station names in title case; a trailing two-letter state goes upper."""
    out = F.initcap(F.regexp_replace(text, r"\s+", " "))
    for small in SMALL_WORDS:
        out = F.regexp_replace(out, rf"(?<= ){small.capitalize()}(?= |$)", small)
    place, state = (F.regexp_extract(out, r"(?s)^(.*, )([A-Za-z]{2})$", g) for g in (1, 2))
    return F.when(state != "", F.concat(place, F.upper(state))).otherwise(out)


def norm_words(text: Column) -> Column:
    """Lower-case ASCII words separated by one space."""
    low = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9 ]+", " ")
    return F.trim(F.regexp_replace(low, r"\s+", " "))


# Plurals without a rule, and plural endings with what takes their place.
IRREGULAR = {"wolves": "wolf", "geese": "goose", "mice": "mouse"}
ENDINGS = ((r"^(.{2,})ies$", "$1y"), (r"^(.*(?:sh|ch|x|s))es$", "$1"), (r"^(|.*[^s])s$", "$1"))


def singular(word: Column) -> Column:
    """The singular of a lower-case word; a word with no known ending is its own."""
    by_ending = [F.when(word.rlike(ending), F.regexp_replace(word, ending, rest)) for ending, rest in ENDINGS]
    return F.coalesce(F.try_element_at(literal_map(IRREGULAR), word), *by_ending, word)


# The words that give a question an intent.
INTENTS = {
    "plan": r"\b(plan|itinerary|day|hours?|route|trip|visit)\b",
    "camp": r"\b(camp|campground|campsite|tent|rv|sleep|stay|lodge|hotel|cabin)\b",
    "hike": r"\b(hike|hiking|trail|walk|walking)\b",
    "when": r"\b(when|month|season|time of year|best time)\b",
    "where": r"\b(where|see|find|spot|spots|most|likely)\b",
    "model": r"\b(model|camera|ai|computer vision|detection|detect)\b",
    "photo": r"\b(photo|picture|image)\b",
    "count": r"\b(how many|number|count|total)\b",
}


def intents(question: Column) -> Column:
    """Names of the intents a question shows, in the fixed order."""
    q = norm_words(question)
    flags = [F.when(q.rlike(pattern), F.lit(name)) for name, pattern in INTENTS.items()]
    return F.array_compact(F.array(*flags))


def month_mentioned(question: Column) -> Column:
    """1-based first month a question names, null when it names none."""
    from observatory.functions.stats import MONTH_NAMES

    q = norm_words(question)
    words = F.split(q, " ")
    hits = [
        F.when(q.contains(m.lower()) | F.array_contains(words, m[:3].lower()), F.lit(i))
        for i, m in enumerate(MONTH_NAMES, start=1)
    ]
    return F.coalesce(*hits)


def cited_facts(answer: Column, fact_count: Column) -> Column:
    """Distinct fact numbers cited as ``[n]`` that exist, in order of mention."""
    found = F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), 1), lambda s: s.try_cast("bigint"))
    return F.filter(F.array_distinct(found), lambda n: n.isNotNull() & (n >= 1) & (n <= fact_count))


def uncited_numbers(answer: Column, fact_text: Column) -> Column:
    """Numbers of three or more digits in an answer that no fact contains; citations such as [2] are none."""
    number = r"\d(?:[\d,.]*\d)?"
    said = F.regexp_extract_all(answer, F.lit(rf"\[\d+\]|{number}"), 0)
    long = F.filter(said, lambda s: ~s.startswith("[") & (F.length(F.translate(s, ",.", "")) >= 3))
    return F.array_except(long, F.regexp_extract_all(fact_text, F.lit(number), 0))


def declines(answer: Column) -> Column:
    return answer.rlike(r"(?i)doesn't say|does not say")


# Words that name a facility and not a place.
FACILITY_WORDS = ("trail", "trailhead", "campground", "campsite", "picnic area", "overlook", "viewpoint", "visitor center")


def place_stem(name: Column) -> Column:
    """A place's own name without facility words; null when nothing usable is left."""
    rest = F.trim(F.regexp_replace(name, rf"(?i)\b(?:{'|'.join(FACILITY_WORDS)})\b", ""))
    return F.nullif(F.regexp_extract(rest, r"(?s)^\D.*$", 0), F.lit(""))


# Attribution texts per source.
def attribution(source: str, observer: Column, license_: Column, url: Column, extra: Column | None = None) -> Column:
    if source == "inaturalist":
        who = F.coalesce(observer, F.lit("iNaturalist user"))
        return F.concat(who, F.lit(" via iNaturalist, "), license_, F.lit(", "), url)
    if source == "gbif":
        who = F.coalesce(observer, F.lit("unknown observer"))
        lic = F.coalesce(license_, F.lit("license unspecified"))
        return F.concat(who, F.lit(" via GBIF ("), F.coalesce(extra, F.lit("None")), F.lit("), "), lic, F.lit(", "), url)
    return F.concat(
        F.coalesce(observer, F.lit("None")), F.lit(" via Mapillary, "), license_, F.lit(", "), url,
        F.lit("; detection by SpeciesNet "), extra,
    )


# Tags of a campground in order, what is said of single values, and of any other ({} is the value; None: nothing).
CAMP_PHRASES = (
    ("backcountry", {"yes": "backcountry"}, None),
    ("capacity", {}, "{} sites"),
    ("fee", {"no": "free"}, "fee"),
    ("reservation", {"no": "first come"}, "reservation {}"),
    ("seasonal", {"no": None}, "seasonal"),
)


def camp_detail(tags: Column, dist_m: Column) -> Column:
    """One line about a campground from its tags."""
    said = []
    for key, single, other in CAMP_PHRASES:
        value = F.nullif(F.try_element_at(tags, F.lit(key)), F.lit(""))
        phrase = F.replace(F.lit(other), F.lit("{}"), value) if other else F.lit(None).cast("string")
        for known, words in single.items():
            phrase = F.when(value == known, F.lit(words)).otherwise(phrase)
        said.append(F.when(value.isNotNull(), phrase))
    return F.concat_ws(" · ", format_distance(dist_m), *said)


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("bigint")


def format_distance(m: Column) -> Column:
    return F.when(m < 950, F.concat((half_up(m / 50) * 50).cast("string"), F.lit(" m"))).otherwise(
        F.concat(F.format_string("%.1f", m / 1000), F.lit(" km"))
    )


def format_km(m: Column) -> Column:
    near = F.concat((half_up(m / 10) * 10).cast("string"), F.lit(" m"))
    mid = F.concat(F.format_string("%.1f", m / 1000), F.lit(" km"))
    far = F.concat(F.format_string("%.0f", m / 1000), F.lit(" km"))
    return F.when(m < 950, near).when(m < 10000, mid).otherwise(far)


def format_time(seconds: Column) -> Column:
    minutes = half_up(seconds / 60)
    hours = F.format_string("%d h %02d min", F.floor(minutes / 60), minutes % 60)
    return F.when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min"))).otherwise(hours)


def to_fahrenheit(c: Column) -> Column:
    return half_up(c * 9 / 5 + 32)


def name_matches(names: Column, query: Column | str) -> Column:
    """Any non-null name contains the trimmed, lower-cased query; an empty one matches all."""
    q = F.lower(F.trim(F.lit(query) if isinstance(query, str) else query))
    hit = F.exists(F.array_compact(names), lambda n: F.contains(F.lower(n), q))
    return (q == "") | hit
