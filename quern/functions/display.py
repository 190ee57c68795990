"""Display values of columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units of time in seconds with their signs; the hue, saturation and
# lightness of languages; the constants of FNV-1a.
UNITS = ((31_536_000, "y"), (2_592_000, "mo"), (86_400, "d"), (3_600, "h"), (60, "m"))
LANGUAGE_COLORS = {
    "Rust": (17, 0.60, 0.55), "Go": (188, 0.66, 0.55), "TypeScript": (219, 0.55, 0.58), "JavaScript": (53, 0.75, 0.58),
    "Python": (207, 0.44, 0.55), "C": (220, 0.13, 0.60), "C++": (338, 0.42, 0.55), "C#": (274, 0.45, 0.50),
    "Java": (25, 0.62, 0.50), "Ruby": (357, 0.72, 0.50), "Shell": (96, 0.42, 0.55), "Swift": (17, 0.90, 0.60),
    "Kotlin": (280, 0.55, 0.60), "Zig": (40, 0.85, 0.55), "Elixir": (277, 0.35, 0.50), "Haskell": (280, 0.30, 0.50),
    "Lua": (240, 0.65, 0.55), "HTML": (13, 0.75, 0.52), "CSS": (271, 0.45, 0.60), "Nix": (215, 0.55, 0.58),
    "Vim Script": (120, 0.55, 0.42), "Dart": (195, 0.75, 0.45), "Scala": (0, 0.75, 0.50), "PHP": (240, 0.25, 0.60),
    "Julia": (280, 0.45, 0.60), "OCaml": (30, 0.85, 0.55), "Objective-C": (215, 0.85, 0.60), "Perl": (210, 0.45, 0.50),
    "R": (210, 0.65, 0.50), "Clojure": (110, 0.55, 0.42), "Erlang": (330, 0.45, 0.45), "Assembly": (10, 0.55, 0.45),
    "Makefile": (140, 0.35, 0.50), "Dockerfile": (207, 0.55, 0.50),
}
OTHER_SATURATION, OTHER_LIGHTNESS = 0.45, 0.55
FNV_START, FNV_FACTOR = 2_166_136_261, 16_777_619
LEAST_SHARE = 0.005
NO_TIME = "—"


#: Values of x.y5, in hundredths, whose nearest binary fraction prints rounded up to one decimal.
ROUNDED_UP = [h for h in range(105, 1000, 10) if round(float(f"{h / 100:.1f}") * 10) * 10 > h]


def _tenth(n: Column, unit: int, sign: str) -> Column:
    """One decimal of n / unit, rounded as its binary fraction prints, without `.0`."""
    step = unit // 100
    h = F.floor(n / F.lit(step))
    up = (h % 10 > 5) | ((h % 10 == 5) & ((n % step > 0) | h.isin(ROUNDED_UP)))
    tenths = F.floor(h / F.lit(10)) + F.when(up, 1).otherwise(0)
    text = F.concat(F.floor(tenths / F.lit(10)).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(sign))
    return F.regexp_replace(text, "\\.0", "")


def compact_count(n: Column) -> Column:
    """950, 1.5k, 39k, 1.5M, 12M; the sign is kept."""
    size = F.abs(n)
    whole = lambda unit, sign: F.concat((F.floor(size / F.lit(unit))).cast("string"), F.lit(sign))
    text = (
        F.when(size < 1_000, size.cast("string")).when(size < 10_000, _tenth(size, 1_000, "k")).when(size < 1_000_000, whole(1_000, "k"))
        .when(size < 10_000_000, _tenth(size, 1_000_000, "M")).otherwise(whole(1_000_000, "M"))
    )
    return F.when(n < 0, F.concat(F.lit("-"), text)).otherwise(text)


def relative_time(then: Column, now: Column) -> Column:
    """How long ago, in one unit, cut; `now` below a minute and for the future; — for null."""
    seconds = F.floor((F.unix_micros(now) - F.unix_micros(then)) / F.lit(1_000_000))
    out = F.when(then.isNull(), NO_TIME)
    for size, sign in UNITS:
        out = out.when(seconds >= size, F.concat(F.floor(seconds / F.lit(size)).cast("string"), F.lit(sign)))
    return out.otherwise("now")


def absolute_date(then: Column) -> Column:
    """18 Feb 2026; — for null."""
    return F.coalesce(F.date_format(then, "d MMM yyyy"), F.lit(NO_TIME))


def language_total(languages: Column) -> Column:
    return F.aggregate(F.map_values(languages), F.lit(0).cast("bigint"), lambda a, b: a + b)


def languages_by_size(languages: Column) -> Column:
    """Entries by size descending, then name."""
    order = lambda a, b: F.when(a["value"] > b["value"], -1).when(a["value"] < b["value"], 1).when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)
    return F.array_sort(F.map_entries(languages), order)


def language_shares(languages: Column) -> Column:
    """name and share of each language, largest first, slivers left out; none if the total isn't positive."""
    total = language_total(languages)
    shares = F.transform(languages_by_size(languages), lambda e: F.struct(e["key"].alias("name"), F.try_divide(e["value"].cast("double"), total).alias("share")))
    kept = F.filter(shares, lambda s: s["share"] >= LEAST_SHARE)
    return F.when(total > 0, kept).otherwise(F.filter(shares, lambda s: F.lit(False)))


def stable_hue(name: Column) -> Column:
    """FNV-1a of the UTF-8 bytes, modulo 360."""
    digits = F.hex(F.encode(name, "UTF-8"))
    places = F.when(F.length(digits) > 0, F.sequence(F.lit(1), F.length(digits), F.lit(2))).otherwise(F.array().cast("array<int>"))
    values = F.transform(places, lambda i: F.conv(F.substr(digits, i, F.lit(2)), 16, 10).cast("bigint"))
    step = lambda h, b: (h.bitwiseXOR(b) * FNV_FACTOR).bitwiseAND(F.lit(0xFFFFFFFF))
    return (F.aggregate(values, F.lit(FNV_START).cast("bigint"), step) % 360).cast("int")


def language_color(name: Column) -> Column:
    """hue, saturation, lightness of a language's dot; a hue from its name if it has none."""
    known = F.create_map(*[x for k, (h, s, l) in LANGUAGE_COLORS.items() for x in (F.lit(k), F.struct(F.lit(h).alias("hue"), F.lit(s).alias("saturation"), F.lit(l).alias("lightness")))])
    other = F.struct(stable_hue(name).alias("hue"), F.lit(OTHER_SATURATION).alias("saturation"), F.lit(OTHER_LIGHTNESS).alias("lightness"))
    return F.coalesce(F.try_element_at(known, name), other)


def format_time(then: Column) -> Column:
    """RFC 3339 in UTC to the second; null stays null."""
    return F.date_format(then, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parse_time(text: Column) -> Column:
    """The instant of an RFC 3339 time; anything else is null, never an error."""
    form = "^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ][0-9]{2}:[0-9]{2}:[0-9]{2}(\\.[0-9]+)?([Zz]|[+-][0-9]{2}:[0-9]{2})$"
    return F.when(text.rlike(form), F.try_to_timestamp(F.regexp_replace(F.upper(text), " ", "T")))


def preview(text: Column, lines: int = 40) -> Column:
    """The first lines of a text, without those that open a comment, right-trimmed."""
    kept = F.filter(F.split(F.regexp_replace(text, "\\r?\\n$", ""), "\\r?\\n"), lambda x: ~F.ltrim(x).startswith("<!--"))
    return F.rtrim(F.array_join(F.slice(kept, 1, lines), "\n"))


def redact(text: Column, secret: str, limit: int = 200) -> Column:
    """The text without the secret, cut to `limit` characters and marked if longer."""
    clean = F.replace(text, F.lit(secret), F.lit("[redacted]")) if secret else text
    return F.when(F.char_length(clean) > limit, F.concat(F.substring(clean, 1, limit), F.lit("…"))).otherwise(clean)


def owner_part(full_name: Column) -> Column:
    """Before the first slash; null without one."""
    return F.when(F.instr(full_name, "/") > 0, F.substring_index(full_name, "/", 1))


def name_part(full_name: Column) -> Column:
    """After the first slash; null without one."""
    at = F.instr(full_name, "/")
    return F.when(at > 0, F.substr(full_name, at + 1))


def tag_cells(tags: Column, most: int = 4) -> Column:
    """name and muted (for the model's own) of the first `most` tags, in their order."""
    return F.transform(F.slice(tags, 1, most), lambda t: F.struct(t["name"].alias("name"), F.coalesce(t["source"] == "ai", F.lit(False)).alias("muted")))
