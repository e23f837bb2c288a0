"""Names of files, groups and versions: builders and parsers as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def _stripped(text: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def safe_name(text: Column) -> Column:
    """Characters other than letters, digits, ``.``, ``_`` and ``-`` become ``_``; runs of ``_`` are one; none at the ends."""
    return F.regexp_replace(F.regexp_replace(_stripped(text), "[^A-Za-z0-9.-]+", "_"), "^_+|_+$", "")


def slug(text: Column) -> Column:
    """Lower case, everything else than letters and digits as one ``-``, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def group_token(text: Column) -> Column:
    """A group's name as it stands in file names: its slug."""
    return slug(text)


def base_name(path: Column) -> Column:
    """The last path part; a slash at the end does not count."""
    return F.regexp_extract(path, "([^/]*)/*$", 1)


def stem(path: Column) -> Column:
    """A video's stem: the last path part without ``.mp4`` in any case; other endings stay."""
    return F.regexp_replace(base_name(_stripped(path)), r"(?i)\.mp4$", "")


def file_stem(path: Column) -> Column:
    """The last path part without its last ending; a leading dot starts no ending."""
    return F.regexp_replace(base_name(path), r"(?<=[^/])\.[^.]+$", "")


def short_key(group: Column, name: Column, length: int = 120) -> Column:
    """``group__name__hash`` of safe names: the name cut, and a hash of the whole safe name."""
    whole = safe_name(name)
    cut = F.when(F.length(whole) > length, F.regexp_replace(F.substring(whole, 1, length), "_+$", "")).otherwise(whole)
    return F.concat(safe_name(group), F.lit("__"), cut, F.lit("__"), F.substring(F.sha1(whole.cast("binary")), 1, 10))


def has_token(text: Column, token: str | Column) -> Column:
    """Whether the slug of ``text`` has the slug of ``token`` as whole words; an empty token is in no text."""
    wanted = slug(F.lit(token) if isinstance(token, str) else token)
    return (wanted != "") & F.concat(F.lit("-"), slug(text), F.lit("-")).contains(F.concat(F.lit("-"), wanted, F.lit("-")))


#: Words that name a route (fixed values).
ROUTE_WORDS = {"day": ("day", "daytime", "day_time"), "night": ("night", "nighttime", "night_time")}


def route_hint(text: Column) -> Column:
    """``day``, ``night``, ``conflict`` if both are named, else null."""
    named = {}
    for route, words in ROUTE_WORDS.items():
        named[route] = has_token(text, words[0])
        for word in words[1:]:
            named[route] = named[route] | has_token(text, word)
    return F.when(named["day"] & named["night"], "conflict").when(named["day"], "day").when(named["night"], "night")


def parse_frame(name: Column, which: str = "last") -> Column:
    """Frame number: a numeric text rounded (halves to even), else the ``last`` group of digits of its last path
    part, or the ``first`` group of digits of the text, else null."""
    number = _stripped(name).try_cast("double")
    whole = F.when(~F.isnan(number) & (F.abs(number) < 9e18), F.bround(number).cast("long"))
    groups = F.regexp_extract_all(base_name(name) if which == "last" else name, F.lit(r"(\d+)"), F.lit(1))
    pick = F.get(groups, F.size(groups) - 1) if which == "last" else F.get(groups, F.lit(0))
    return F.coalesce(whole, pick.try_cast("long"))


def parse_crop_name(name: Column) -> Column:
    """``f_t_x_y_w_h_p`` -> struct<t, x, y, w, h, p>; null if it has another form."""
    parts = F.split(stem_keep_dots(name), "_")
    fields = [parts[i].try_cast("int").alias(k) for i, k in enumerate(("t", "x", "y", "w", "h"), 1)]
    return F.when(name.rlike(r"^f(_-?\d+){5}_[0-9.]+\.png$"), F.struct(*fields, parts[6].try_cast("double").alias("p")))


def stem_keep_dots(name: Column) -> Column:
    return F.regexp_replace(name, r"\.(png|jpg|csv)$", "")


def parse_exposure_name(name: Column, modes: tuple[str, ...] = ("lighten", "average", "trails")) -> Column:
    """``<n>_<video>_<mode>_<start>-<end>`` -> struct; the video may hold ``_``; null if it has another form."""
    pattern = r"^(\d+)_(.+)_(" + "|".join(modes) + r")_(\d+)-(\d+)$"
    part = lambda i: F.regexp_extract(name, pattern, i)
    return F.when(name.rlike(pattern), F.struct(part(1).try_cast("int").alias("interval"), part(2).alias("video"), part(3).alias("mode"), part(4).try_cast("long").alias("t_start"), part(5).try_cast("long").alias("t_end")))


def parse_patch_name(name: Column) -> Column:
    """``<x>_<y>_<w>_<h>_<t>_<video>_<group>.png`` -> struct; the video may hold ``_``; null if it has another form."""
    pattern = r"^(-?\d+)_(-?\d+)_(\d+)_(\d+)_(\d+)_(.+)_([^_]+)\.png$"
    part = lambda i: F.regexp_extract(name, pattern, i)
    numbers = [part(i).try_cast("int").alias(k) for i, k in enumerate(("x", "y", "w", "h", "t"), 1)]
    return F.when(name.rlike(pattern), F.struct(*numbers, part(6).alias("video"), part(7).alias("grp")))


def parse_identity(name: Column) -> Column:
    """``<video>_<group>_<day|night>_time_<label>.csv`` -> struct; the label defaults to ``positive``."""
    pattern = r"^(.+)_([^_]+)_(day|night)_time(?:_([A-Za-z]+))?\.csv$"
    part = lambda i: F.regexp_extract(name, pattern, i)
    return F.when(name.rlike(pattern), F.struct(part(1).alias("video"), part(2).alias("grp"), part(3).alias("route"), F.coalesce(F.nullif(F.lower(part(4)), F.lit("")), F.lit("positive")).alias("label")))


def parse_version(name: Column) -> Column:
    """The number of ``v<n>`` or ``v<n>_<date>``; null otherwise."""
    return F.nullif(F.regexp_extract(name, r"^v(\d+)(?:_.*)?$", 1), F.lit("")).try_cast("int")


def label_from_name(name: Column, video: Column | None = None) -> Column:
    """``positive`` or ``negative`` if that is the name's whole last word between ``_``; else positive.

    With a ``video`` whose name starts the file's (as it is, or with ``-``, ``(``, ``)`` as ``_``), only what
    follows it counts, so that a video called ``a_negative`` has a positive table of that name.
    """

    def plain(text: Column) -> Column:
        return F.lower(F.regexp_replace(F.regexp_replace(text, "[-()_]+", "_"), "^_+|_+$", ""))

    def behind(text: Column, start: Column) -> Column:
        found = (start != "") & ((text == start) | F.startswith(text, F.concat(start, F.lit("_"))))
        return F.when(found, F.substring(text, F.length(start) + 1, F.length(text)))

    raw, key = F.lower(_stripped(file_stem(name))), plain(_stripped(file_stem(name)))
    rest = key
    if video is not None:
        start = F.lower(_stripped(F.coalesce(video, F.lit(""))))
        rest = F.coalesce(behind(raw, start), behind(key, plain(start)), key)
    word = F.regexp_extract(rest, "(?:^|_)(positive|negative)_*$", 1)
    return F.coalesce(F.nullif(word, F.lit("")), F.lit("positive"))


def parse_metrics(text: Column) -> Column:
    """``tp=1 fp=2 fn=0 precision=0.5 ...`` -> struct<status, error, tp, fp, fn, precision, recall, accuracy, f1>.

    ``not_run`` for an empty text, ``error`` for ``ERROR: reason`` and for a text without all three whole
    counts, else ``ok``. Recall always follows from the counts; precision, accuracy and f1 do where they are
    not given. Of a key given twice the last counts.
    """

    def bound(value: Column, then: Callable[[Column], Column]) -> Column:
        """``then`` of a value that is computed once."""
        return F.get(F.transform(F.array(value), then), F.lit(0))

    def given(words: Column, key: str) -> Column:
        mine = F.filter(words, lambda w: F.startswith(w, F.lit(key + "=")))
        return F.substring(F.get(mine, F.size(mine) - 1), len(key) + 2, 1 << 20)

    def fields(words: Column) -> Column:
        counts = (F.when(given(words, k).rlike(r"^[+-]?\d+$"), given(words, k).try_cast("long")).alias(k) for k in ("tp", "fp", "fn"))
        return F.struct(*counts, *(given(words, k).try_cast("double").alias(k) for k in ("precision", "accuracy", "f1")))

    def rates(s: Column) -> Column:
        tp, fp, fn = s["tp"], s["fp"], s["fn"]
        share = lambda part, whole: F.when(whole > 0, part / whole).otherwise(F.lit(0.0))
        return F.struct(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), F.coalesce(s["precision"], share(tp, tp + fp)).alias("precision"), share(tp, tp + fn).alias("recall"), F.coalesce(s["accuracy"], share(tp, tp + fp + fn)).alias("accuracy"), s["f1"].alias("f1"), (tp + fp + fn).isNotNull().alias("counted"))

    def result(plain: Column) -> Column:
        words = F.filter(F.split(plain, r"\s+"), lambda w: w.contains("="))
        return bound(bound(bound(words, fields), rates), lambda s: finished(plain, s))

    def finished(plain: Column, s: Column) -> Column:
        failed = F.startswith(plain, F.lit("ERROR:"))
        status = F.when(plain == "", "not_run").when(failed | ~s["counted"], "error").otherwise("ok")
        error = F.when(failed, _stripped(F.substring(plain, 7, 1 << 20))).when((plain != "") & ~s["counted"], F.concat(F.lit("unable to parse metric summary: "), plain)).otherwise("")
        both = s["precision"] + s["recall"]
        f1 = F.coalesce(s["f1"], F.when(both > 0, 2.0 * s["precision"] * s["recall"] / both).otherwise(F.lit(0.0)))
        good = s["counted"] & ~failed
        known = (F.when(good, v).alias(k) for k, v in {**{k: s[k] for k in ("tp", "fp", "fn", "precision", "recall", "accuracy")}, "f1": f1}.items())
        return F.struct(status.alias("status"), error.alias("error"), *known)

    return bound(F.coalesce(_stripped(text), F.lit("")), result)


def threshold_name(threshold: Column) -> Column:
    return F.format_string("thr_%.1fpx", threshold.cast("double"))


def signed_offset(value: Column) -> Column:
    return F.format_string("%+d", value.cast("long"))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)
