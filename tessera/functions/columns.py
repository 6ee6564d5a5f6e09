"""Scalar functions as Column expressions: names, sizes, times, versions, text clean-up, markup escapes, sheet references.

All run inside whole-stage code generation. Lengths count code points. What cannot be read gives null, never a guess.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KILO, MEGA, GIGA = 1 << 10, 1 << 20, 1 << 30
#: Characters that no file name may hold (fixed values).
ILLEGAL_IN_NAMES = '<>:"/\\\\|?*\n\r\t'


# -- sizes and times ------------------------------------------------------------------------------------------------


def size_parse(text: Column) -> Column:
    """Bytes of a size such as `1.5 GB`, `300k` or `2,5`; without a unit, megabytes. Null for anything else and for 0."""
    clean = F.lower(F.regexp_replace(F.trim(text), "[,，　]", ""))
    pattern = r"^([0-9]*\.?[0-9]+)\s*([kmgt]b?|兆|吉|千字节)?$"
    value = F.regexp_extract(clean, pattern, 1).try_cast("double")
    unit = F.regexp_extract(clean, pattern, 2)
    factor = F.when(unit.isin("", "m", "mb", "兆"), MEGA).when(unit.isin("k", "kb", "千字节"), KILO).when(unit.isin("g", "gb", "吉"), GIGA).when(unit == "tb", GIGA * KILO)
    return F.when(value > 0, (value * factor).cast("long"))


def size_format(size: Column) -> Column:
    """A size with one decimal at most: `512 B`, `1.5 KB`, `3 MB`."""

    def short(x: Column) -> Column:
        tenths = F.floor(x * 10 + 0.5).cast("long")
        whole = F.floor(tenths / 10).cast("long").cast("string")
        return F.when(tenths % 10 == 0, whole).otherwise(F.concat(whole, F.lit("."), (tenths % 10).cast("string")))

    def below(x: Column) -> Column:
        return F.floor(x * 10 + 0.5) < KILO * 10

    kb = size.cast("double") / KILO
    mb, gb = kb / KILO, kb / MEGA
    return F.when(size < KILO, F.concat(size.cast("string"), F.lit(" B"))).when(below(kb), F.concat(short(kb), F.lit(" KB"))).when(below(mb), F.concat(short(mb), F.lit(" MB"))).otherwise(F.concat(short(gb), F.lit(" GB")))


def time_seconds(text: Column) -> Column:
    """Seconds of `90`, `1:30` or `1:02:03.5`; null for more parts, signs or anything else."""
    parts = F.transform(F.split(F.trim(text), ":"), lambda x: F.when(F.trim(x).rlike(r"^\+?(\d+\.?\d*|\.\d+)$"), F.trim(x).try_cast("double")))
    total = F.aggregate(parts, F.lit(0.0), lambda acc, x: acc * 60 + x)
    return F.when((F.trim(text) != "") & (F.size(parts) <= 3), total)


def time_ranges(text: Column) -> Column:
    """Array of (start, end) seconds of `0-10, 1:00-`; an open end is null, unreadable and reversed ranges are left out."""

    def one(part: Column) -> Column:
        bits = F.split(F.trim(part), "-")
        end = F.trim(F.get(bits, F.lit(1)))
        opened = F.coalesce(end, F.lit("")) == ""
        start, stop = time_seconds(F.get(bits, F.lit(0))), time_seconds(end)
        good = start.isNotNull() & (opened | (stop > start))
        return F.when(good, F.struct(start.alias("start"), F.when(~opened, stop).alias("end")))

    return F.filter(F.transform(F.split(text, "[,，]"), one), lambda r: r.isNotNull())


def clock(ms: Column, mark: str = ",") -> Column:
    """Milliseconds as `HH:MM:SS,mmm`."""
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def day_group(added: Column, now: Column) -> Column:
    """today, yesterday, week (from Monday on) or earlier, by calendar days of the session's time zone."""
    days = F.datediff(now, added)
    return F.when(days <= 0, "today").when(days == 1, "yesterday").when(F.to_date(added) >= F.to_date(F.date_trunc("week", now)), "week").otherwise("earlier")


# -- names ----------------------------------------------------------------------------------------------------------


def stem(name: Column) -> Column:
    """The last path segment without its extension; a leading dot begins no extension."""
    last = F.regexp_extract(name, r"(?s)([^/\\]*)$", 1)
    return F.regexp_replace(last, r"(?s)^(.+)\.[^.]*$", "$1")


def extension(name: Column, fallback: str = "pdf") -> Column:
    found = F.regexp_extract(name, r"(?s)\.([^.]+)$", 1)
    return F.when(found == "", fallback).otherwise(F.lower(found))


def sanitize(name: Column) -> Column:
    """Without characters that file systems forbid, outer spaces and final dots; `file` if nothing is left."""
    clean = F.regexp_replace(F.trim(F.regexp_replace(name, f"[{ILLEGAL_IN_NAMES}]", "")), r"[. ]+$", "")
    return F.when(F.trim(clean) == "", "file").otherwise(clean)


def tagged(name: Column, tag: Column, ext: Column) -> Column:
    clean = sanitize(stem(name))
    return F.when(F.trim(tag) == "", F.concat(clean, F.lit("."), ext)).otherwise(F.concat(clean, F.lit("_"), tag, F.lit("."), ext))


def part_name(name: Column, part: Column, total: Column, ext: Column) -> Column:
    width = F.greatest(F.lit(2), F.length(total.cast("string")))
    return F.concat(sanitize(stem(name)), F.lit("_part"), F.lpad(part.cast("string"), width, F.lit("0")), F.lit("."), ext)


def flatten_path(path: Column, unnamed: str = "unnamed") -> Column:
    """A member's path as one name: segments joined by `_`, without `.` and `..`; forbidden and control characters become `_`.

    Names over 96 characters are cut, the extension stays."""
    segments = F.filter(F.split(path, r"[/\\]"), lambda s: (F.trim(s) != "") & ~s.isin(".", ".."))
    clean = F.transform(segments, lambda s: F.regexp_replace(F.regexp_replace(s, '[\\x00-\\x1f:*?"<>|]', "_"), r"^\.+", ""))
    joined = F.array_join(clean, "_")
    ext = F.regexp_extract(joined, r"\.([^.]*)$", 1)
    keep = F.greatest(F.lit(96) - F.when(ext == "", 0).otherwise(F.length(ext) + 1), F.lit(4))
    cut = F.concat(F.substr(joined, F.lit(1), keep), F.when(ext == "", "").otherwise(F.concat(F.lit("."), ext)))
    return F.when(F.size(segments) == 0, unnamed).when(F.length(joined) <= 96, joined).otherwise(cut)


# -- versions and digests -------------------------------------------------------------------------------------------


def version_parts(text: Column) -> Column:
    """The numbers of `v1.2.3`, without final zeros so that 1.2 equals 1.2.0; null unless there are two parts of digits or more."""
    clean = F.regexp_replace(F.trim(text), "^[vV]+", "")
    numbers = F.transform(F.split(clean, r"\."), lambda x: x.try_cast("int"))
    kept = F.greatest(F.lit(0), F.size(numbers) - F.coalesce(F.array_position(F.transform(F.reverse(numbers), lambda x: x != 0), True), F.lit(0)).cast("int") + 1)
    zero = F.aggregate(numbers, F.lit(True), lambda a, x: a & (x == 0))
    return F.when(clean.rlike(r"^\d+(\.\d+)+$") & ~F.exists(numbers, lambda x: x.isNull()), F.when(zero, F.array().cast("array<int>")).otherwise(F.slice(numbers, 1, kept)))


def version_compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1."""
    x, y = version_parts(a), version_parts(b)
    return F.when(x < y, -1).when(x > y, 1).when(x == y, 0)


def digest_from_notes(notes: Column, asset: Column) -> Column:
    """The SHA-256 that release notes give for an asset: on a line that names it, else the only one in the notes."""
    lines = F.split(notes, r"\r\n|\n|\r")
    hexes = F.transform(F.filter(lines, lambda x: F.contains(F.lower(x), F.lower(asset))), lambda x: F.regexp_extract(x, "[0-9a-fA-F]{64}", 0))
    named = F.get(F.filter(hexes, lambda x: x != ""), F.lit(0))
    every = F.array_distinct(F.transform(F.regexp_extract_all(notes, F.lit("([0-9a-fA-F]{64})")), F.lower))
    return F.coalesce(F.lower(named), F.when(F.size(every) == 1, F.get(every, F.lit(0))))


# -- text -----------------------------------------------------------------------------------------------------------


def eol_counts(text: Column) -> Column:
    """(crlf, cr, lf): line ends of each kind."""
    crlf = F.regexp_count(text, F.lit("\r\n"))
    return F.struct(crlf.alias("crlf"), (F.regexp_count(text, F.lit("\r")) - crlf).alias("cr"), (F.regexp_count(text, F.lit("\n")) - crlf).alias("lf"))


def eol_main(text: Column) -> Column:
    """The commonest line end; ties go to crlf, then lf. Null without any."""
    n = eol_counts(text)
    most = F.greatest(n["crlf"], n["lf"], n["cr"])
    return F.when(most == 0, None).when(n["crlf"] == most, "crlf").when(n["lf"] == most, "lf").otherwise("cr")


def to_eol(text: Column, eol: str = "\n") -> Column:
    return F.regexp_replace(text, "\r\n|\r|\n", eol)


def ocr_normalize(text: Column) -> Column:
    """One kind of line end, no spaces at line ends, two line ends in a row at most, nothing blank outside."""
    lines = F.transform(F.split(to_eol(text), "\n"), lambda x: F.regexp_replace(x, r"[\s  - 　]+$", ""))
    return F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"), r"^[\s　]+|[\s　]+$", "")


def nonblank_chars(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S"))


def html_escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def attribute_escape(text: Column) -> Column:
    return F.replace(html_escape(text), F.lit('"'), F.lit("&quot;"))


def text_units(text: Column) -> Column:
    """Estimated width in ems: 1 for characters from U+2E80 on, else 0.55."""
    wide = F.regexp_count(text, F.lit(r"[\x{2e80}-\x{10ffff}]"))
    return wide + (F.length(text) - wide) * 0.55


# -- tables as text -------------------------------------------------------------------------------------------------


def csv_cell(cell: Column, delimiter: str = ",", quote_all: bool = False) -> Column:
    """Quoted if it holds the delimiter, a quote or a line end; spaces and emptiness need none. Null is empty."""
    text = F.coalesce(cell.cast("string"), F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    if quote_all:
        return quoted
    return F.when(F.contains(text, F.lit(delimiter)) | text.rlike('["\r\n]'), quoted).otherwise(text)


def csv_row(cells: list[Column], delimiter: str = ",", eol: str = "\n", quote_all: bool = False) -> Column:
    return F.concat(F.concat_ws(delimiter, *(csv_cell(c, delimiter, quote_all) for c in cells)), F.lit(eol))


def markdown_row(cells: list[Column]) -> Column:
    clean = [F.regexp_replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), "\r\n|\r|\n", " ") for c in cells]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *clean), F.lit(" |"))


def html_row(cells: list[Column], tag: str = "td") -> Column:
    return F.concat(F.lit("<tr>"), *(F.concat(F.lit(f"<{tag}>"), html_escape(F.coalesce(c.cast("string"), F.lit(""))), F.lit(f"</{tag}>")) for c in cells), F.lit("</tr>"))


def xml_row(tag: str, cells: dict[str, Column]) -> Column:
    return F.concat(F.lit(f"<{tag}>"), *(F.concat(F.lit(f"<{k}>"), html_escape(F.coalesce(c.cast("string"), F.lit(""))), F.lit(f"</{k}>")) for k, c in cells.items()), F.lit(f"</{tag}>"))


def json_literal(text: Column, infer: bool = False) -> Column:
    """A cell as JSON: a string, or with `infer` the number or truth value that it spells, as spelt."""
    string = F.regexp_extract(F.to_json(F.struct(F.coalesce(text, F.lit("")).alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)
    if not infer:
        return string
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(r"^-?(0|[1-9]\d*)(\.\d+)?([eE][-+]?\d+)?$") | trimmed.isin("true", "false"), trimmed).otherwise(string)


def keeps_meaning(text: Column) -> Column:
    """Whether a cell may become a typed number: its spelling comes back and it has 15 digits at most."""
    return text.rlike(r"^-?(0|[1-9]\d*)(\.\d*[1-9])?$") & (F.length(F.regexp_replace(text, "[^0-9]", "")) <= 15) & (text != "-0")


def column_ref(index: Column) -> Column:
    """Sheet letters of a column counted from 0: A, Z, AA, ..., XFD."""
    n = index.cast("long")

    def letter(x: Column) -> Column:
        return F.char((x % 26 + 65).cast("int"))

    return F.when(n < 26, letter(n)).when(n < 702, F.concat(letter(F.floor((n - 26) / 26)), letter(n - 26))).otherwise(
        F.concat(letter(F.floor((n - 702) / 676)), letter(F.floor((n - 702) / 26)), letter(n - 702))
    )


def column_index(ref: Column) -> Column:
    """The inverse of column_ref."""
    letters = F.split(F.upper(ref), "")
    return F.aggregate(letters, F.lit(0).cast("long"), lambda acc, c: acc * 26 + (F.ascii(c) - 64).cast("long")) - 1


def excel_date(serial: Column, epoch_1904: bool = False) -> Column:
    """ISO date, with time if there is any, of a sheet's day number; day 60 of the 1900 system is the 1900-02-29 that never was."""
    days = F.floor(serial)
    seconds = F.floor((serial - days) * 86400 + 0.5).cast("int")
    if epoch_1904:
        base = F.date_add(F.lit("1904-01-01").cast("date"), days.cast("int"))
    else:
        base = F.date_add(F.when(days < 60, F.lit("1899-12-31")).otherwise(F.lit("1899-12-30")).cast("date"), days.cast("int"))
    day = base.cast("string") if epoch_1904 else F.when(days == 60, "1900-02-29").otherwise(base.cast("string"))
    return F.when(seconds == 0, day).otherwise(F.concat(day, F.lit(" "), F.format_string("%02d:%02d:%02d", F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60)))


# -- samples and geometry -------------------------------------------------------------------------------------------


def pcm_gain(samples: Column, percent: int) -> Column:
    """16-bit samples times percent / 100, halves rounded up, kept in range."""
    if not 0 <= percent <= 400:
        raise ValueError("the volume must be 0 to 400 %")
    return F.transform(samples, lambda x: F.least(F.greatest(F.floor(x * (percent / 100.0) + 0.5).cast("int"), F.lit(-32768)), F.lit(32767)))


def pcm_denoise(samples: Column, level: int) -> Column:
    """A first-order high-pass in whole numbers, then silence below the level's threshold (one channel)."""
    threshold = {1: 200, 2: 500, 3: 1000}[level]
    zero = F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        x = x.cast("int")
        scaled = acc["y"] * 995
        y = x - acc["x"] + F.when(scaled < 0, -F.floor(-scaled / 1000)).otherwise(F.floor(scaled / 1000)).cast("int")
        heard = F.when(F.abs(y) < threshold, 0).otherwise(F.least(F.greatest(y, F.lit(-32768)), F.lit(32767)))
        return F.struct(x.alias("x"), y.alias("y"), F.concat(acc["out"], F.array(heard)).alias("out"))

    return F.aggregate(samples, zero, step, lambda acc: acc["out"])


def video_bitrate(target_bytes: Column, duration_us: Column, audio_bps: Column, least: int = 200_000, most: int = 40_000_000) -> Column:
    """Bits a second that a target size leaves for the picture after 6 % of container and the sound; null if too few."""
    usable = F.floor(target_bytes.cast("double") * 8 * 0.94).cast("long") - F.floor(audio_bps.cast("long") * duration_us / 1_000_000).cast("long")
    rate = F.floor(usable.cast("decimal(38,0)") * 1_000_000 / duration_us).cast("long")
    return F.when((target_bytes > 0) & (duration_us > 0) & (usable > 0) & (rate >= least), F.least(rate, F.lit(most)))


def rotated_box(width: Column, height: Column, degrees: Column) -> Column:
    """(width, height) of the canvas that holds a turned image; quarter turns are exact."""
    turn = F.pmod(degrees, F.lit(360))
    a, b = F.abs(F.cos(F.radians(turn))), F.abs(F.sin(F.radians(turn)))
    w, h = width * a + height * b, width * b + height * a
    exact = F.when(turn.isin(0, 180), F.struct(width.cast("double").alias("width"), height.cast("double").alias("height"))).when(turn.isin(90, 270), F.struct(height.cast("double").alias("width"), width.cast("double").alias("height")))
    return F.coalesce(exact, F.struct(F.ceil(w - 1e-6).cast("double").alias("width"), F.ceil(h - 1e-6).cast("double").alias("height")))


def resize_page(width: Column, height: Column, rotation: Column, paper_width: float, paper_height: float, mode: str = "contain") -> Column:
    """(scale_x, scale_y, translate_x, translate_y, box_width, box_height) that fits a page to paper: contain, cover or stretch.

    The paper lies like the page as seen, and the factors hold in the page's own, unturned space."""
    swapped = F.pmod(rotation, F.lit(360)).isin(90, 270)
    seen_w, seen_h = F.when(swapped, height).otherwise(width), F.when(swapped, width).otherwise(height)
    short, long = min(paper_width, paper_height), max(paper_width, paper_height)
    target_w, target_h = F.when(seen_w > seen_h, long).otherwise(short), F.when(seen_w > seen_h, short).otherwise(long)
    sx, sy = target_w / seen_w, target_h / seen_h
    if mode != "stretch":
        sx = sy = F.least(sx, sy) if mode == "contain" else F.greatest(sx, sy)
    ux, uy = F.when(swapped, sy).otherwise(sx), F.when(swapped, sx).otherwise(sy)
    box_w, box_h = F.when(swapped, target_h).otherwise(target_w), F.when(swapped, target_w).otherwise(target_h)
    return F.struct(ux.alias("scale_x"), uy.alias("scale_y"), ((box_w - width * ux) / 2).alias("translate_x"), ((box_h - height * uy) / 2).alias("translate_y"), box_w.alias("box_width"), box_h.alias("box_height"))


def watermark_tiles(width: Column, height: Column, columns: int, rows: int) -> Column:
    """Centres (x, y) of a grid of stamps, row by row; 1 to 12 each way."""
    cols, lines = min(max(columns, 1), 12), min(max(rows, 1), 12)
    w, h = F.greatest(width.cast("double"), F.lit(1.0)), F.greatest(height.cast("double"), F.lit(1.0))
    return F.array(*(F.struct((w * (c + 0.5) / cols).alias("x"), (h * (r + 0.5) / lines).alias("y")) for r in range(lines) for c in range(cols)))


def page_number_anchor(width: Column, height: Column, spot: str, margin: float, font_size: float) -> Column:
    """(x, y) of a page number at bottom_center, bottom_right, bottom_left or top_center."""
    side, align = spot.split("_")
    w = F.greatest(width.cast("double"), F.lit(1.0))
    x = {"left": F.lit(float(margin)), "center": w / 2, "right": w - margin}[align]
    y = F.lit(margin + font_size * 0.25) if side == "bottom" else height - margin - font_size
    return F.struct(x.alias("x"), F.greatest(y, F.lit(0.0)).alias("y"))


# -- document properties ------------------------------------------------------------------------------------------------

#: Standard properties and dates of a document (fixed values).
PROPERTIES = ("Title", "Author", "Subject", "Keywords", "Creator", "Producer")
DATES = ("CreationDate", "ModDate")
MOST_PROPERTY = 400


def metadata_patch(properties: Column, mode: str = "edit", changes: dict[str, str] | None = None, keep_dates: bool = False) -> Column:
    """A map of properties after editing (blank changes keep what is, long ones are cut), `clear` (all) or `clear-standard` (all but custom ones)."""
    if mode not in ("edit", "clear", "clear-standard"):
        raise ValueError(f"no mode {mode}")
    if mode == "edit":
        new = {k: v.strip()[:MOST_PROPERTY] for k, v in (changes or {}).items() if k in PROPERTIES and v.strip()}
        if not new:
            return properties
        put = F.create_map(*(F.lit(x) for pair in new.items() for x in pair))
        return F.map_concat(F.map_filter(properties, lambda k, v: ~k.isin(*new)), put)
    if mode == "clear":
        return F.map_filter(properties, lambda k, v: k.isin(*DATES) if keep_dates else F.lit(False))
    gone = PROPERTIES + (() if keep_dates else DATES)
    return F.map_filter(properties, lambda k, v: ~k.isin(*gone))


def form_values(spec: Column) -> Column:
    """Map of `name=value` lines: the first `=` splits, the last of equal names counts, lines without a name are left out."""
    lines = F.filter(F.split(spec, "\r\n|\n|\r"), lambda x: F.contains(x, F.lit("=")) & (F.trim(F.substring_index(x, "=", 1)) != ""))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("key"), F.trim(F.substr(x, F.instr(x, "=") + 1)).alias("value")))
    last = F.filter(F.transform(pairs, lambda p, i: F.struct(p["key"].alias("key"), p["value"].alias("value"), i.alias("i"))), lambda p: ~F.exists(F.slice(pairs, p["i"] + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["key"], p["value"])))


def crop_page(left: Column, bottom: Column, right: Column, top: Column, margin: float) -> Column:
    """(left, bottom, right, top) of a page's box without a margin on all sides; null if nothing would be left."""
    box = F.struct((left + margin).alias("left"), (bottom + margin).alias("bottom"), (right - margin).alias("right"), (top - margin).alias("top"))
    return F.when((right - left > 2 * margin) & (top - bottom > 2 * margin), box)


def ocr_page(number: Column, total: Column, text: Column, empty: str = "(no text)") -> Column:
    """A page's recognised text under a fence with its number; a page without any says so."""
    body = ocr_normalize(text)
    return F.concat(F.format_string("===== page %d / %d =====\n", number, total), F.when(body == "", empty).otherwise(body))
