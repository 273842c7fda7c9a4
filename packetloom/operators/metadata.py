"""Key and value metadata: collecting repeated tags, precedence, merging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def collect_tags(entries: DataFrame, keys: Sequence[str], single: Sequence[str] = ("ALBUM", "TITLE", "DATE")) -> DataFrame:
    """entries (keys, pos, key, value): tags of the same key appended in their order, but of single ones the first only."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"])
    many = entries.filter(~F.col("key").isin(*single)).groupBy(*keys, "key").agg(ordered.alias("values"))
    one = entries.filter(F.col("key").isin(*single)).groupBy(*keys, "key").agg(F.array(F.min_by("value", "pos")).alias("values"))
    return many.unionByName(one)


def comment_fallback(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The first entry without `=` is the comment."""
    return lines.groupBy(*keys).agg(F.min_by("line", F.when(~F.col("line").contains("="), F.col("pos"))).alias("comment"))


#: Two-letter language codes and the bibliographic three-letter ones.
LANGUAGES = {
    "ar": "ara", "bg": "bul", "bs": "bos", "ca": "cat", "cs": "cze", "cy": "wel", "da": "dan", "de": "ger", "el": "gre", "en": "eng", "es": "spa", "et": "est", "eu": "baq", "fa": "per", "fi": "fin", "fr": "fre",
    "ga": "gle", "gl": "glg", "he": "heb", "hi": "hin", "hr": "hrv", "hu": "hun", "hy": "arm", "id": "ind", "is": "ice", "it": "ita", "ja": "jpn", "ka": "geo", "ko": "kor", "la": "lat", "lt": "lit", "lv": "lav",
    "mk": "mac", "ms": "may", "nl": "dut", "no": "nor", "pl": "pol", "pt": "por", "ro": "rum", "ru": "rus", "sk": "slo", "sl": "slv", "sq": "alb", "sr": "srp", "sv": "swe", "th": "tha", "tr": "tur", "uk": "ukr",
    "ur": "urd", "vi": "vie", "zh": "chi",
}
#: Terminological codes that differ from the bibliographic ones.
TERMINOLOGICAL = {
    "bod": "tib", "ces": "cze", "cym": "wel", "deu": "ger", "ell": "gre", "eus": "baq", "fas": "per", "fra": "fre", "hye": "arm", "isl": "ice", "kat": "geo", "mkd": "mac", "mri": "mao", "msa": "may", "mya": "bur",
    "nld": "dut", "ron": "rum", "slk": "slo", "sqi": "alb", "zho": "chi",
}


def language(code: Column, more: dict[str, str] | None = None) -> Column:
    """A language code as the bibliographic one of three letters; what stands behind a hyphen or an underscore is left out for the look-up. A code that isn't known stays as it is. `more`
    adds codes or names, in lower case."""
    table = LANGUAGES | TERMINOLOGICAL | (more or {})
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(F.regexp_extract(code, "^([^-_]*)", 1))), F.try_element_at(known, F.lower(code)), code)


def merge_maps(own: Column, inherited: Column) -> Column:
    """A track's own metadata, and the input's where the track has none of that key."""
    mine = F.coalesce(own, F.create_map().cast("map<string,string>"))
    more = F.map_filter(F.coalesce(inherited, F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key(mine, k))
    return F.map_concat(mine, more)


def state_changes(events: DataFrame, keys: Sequence[str], order: str, width: int) -> DataFrame:
    """State messages are sent once, and then only when the value changes."""
    from . import scan

    out = scan.lag(events, keys, order, {"__before": F.col("value"), "__any": F.lit(True)}, width)
    return out.filter(F.col("__any").isNull() | ~F.col("value").eqNullSafe(F.col("__before"))).drop("__before", "__any")
