"""Text kernel: folding, words, titles, keys. All are column expressions that stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Base letters of accented ones, in two parallel lists, and those that become two letters.
ACCENTED = "áàäâãåéèëêíìïîóòöôõøúùüûñçąęıýÿćčďđğłńňřśšşťźżž"
BASE = "aaaaaaeeeeiiiioooooouuuuncaeiyyccddglnnrssstzzz"
TWO = (("æ", "ae"), ("œ", "oe"), ("ß", "ss"))
ARTICLES = ("the", "el", "la", "los", "las", "le", "les", "il", "lo")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A dotless i has no upper case of its own here.
_PAIRS = [(a, b) for a, b in zip(ACCENTED, BASE)]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ascii_lower(c) -> Column:
    """Lower case of A-Z only (a case-insensitive order that leaves other letters alone)."""
    return F.translate(col(c), UPPER, LOWER)


def drop_marks(c) -> Column:
    return F.regexp_replace(col(c), r"\p{Mn}", "")


def fold(c) -> Column:
    """Lower case, no combining marks, base letters."""
    x = F.translate(drop_marks(F.lower(col(c))), ACCENTED, BASE)
    for a, b in TWO:
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def strip_accents(c) -> Column:
    """Base letters with case and punctuation kept; letters that fold to two stay."""
    up = [(a.upper(), b.upper()) for a, b in _PAIRS if len(a.upper()) == 1 and a.upper() not in UPPER]
    return F.translate(drop_marks(c), ACCENTED + "".join(a for a, _ in up), BASE + "".join(b for _, b in up))


def words(c) -> Column:
    """Folded runs of letters and digits."""
    return F.filter(F.split(fold(c), r"[^\p{L}\p{Nd}]+"), lambda w: w != "")


def norm_words(c) -> Column:
    w = words(c)
    return F.when((F.size(w) > 1) & F.element_at(w, 1).isin(*ARTICLES), F.slice(w, 2, F.greatest(F.size(w), F.lit(1)))).otherwise(w)


def norm_title(c) -> Column:
    """Words without one leading article, joined by a space."""
    return F.array_join(norm_words(c), " ")


def group_key(title, year) -> Column:
    """'title|year', '' for a title without words (which never groups)."""
    t = norm_title(title)
    return F.when(t == "", "").otherwise(F.concat_ws("|", t, col(year).cast("string")))


def similarity(a, b) -> Column:
    """1 - edit distance over the longer length, of normal titles; 0 if either is empty."""
    x, y = norm_title(a), norm_title(b)
    n = F.greatest(F.length(x), F.length(y))
    return F.when((x == "") | (y == ""), 0.0).otherwise(1 - F.levenshtein(x, y) / n)


def title_score(parsed, title, original) -> Column:
    return 0.60 * F.greatest(similarity(parsed, title), similarity(parsed, original))


def year_score(parsed, candidate) -> Column:
    """0.10 without a year to compare, 0.25 for the same, 0.15 for one off, else 0."""
    p, c = col(parsed), col(candidate)
    return F.when(p == 0, 0.10).when(c == 0, 0.0).when(p == c, 0.25).when(F.abs(p - c) == 1, 0.15).otherwise(0.0)


def director_matches(parsed, directors) -> Column:
    """The last word of the parsed director is a word of some director (lenient)."""
    last = F.try_element_at(words(parsed), F.lit(-1))
    return F.coalesce(F.exists(col(directors), lambda d: F.array_contains(words(d), last)), F.lit(False))


def surname_matches(parsed, directors) -> Column:
    """The last word of the parsed director is the last word of some director (strict)."""
    last = F.try_element_at(words(parsed), F.lit(-1))
    return F.coalesce(F.exists(col(directors), lambda d: F.try_element_at(words(d), F.lit(-1)) == last), F.lit(False))


def runtime_matches(runtime, minutes) -> Column:
    """Within 5 minutes or 8 %, whichever is more; unknown runtimes don't match."""
    r, m = col(runtime), col(minutes)
    return (r > 0) & (m > 0) & (F.abs(r - m) <= F.greatest(F.lit(5), F.floor(m * 8 / 100)))


def title_variants(title) -> Column:
    """The text outside brackets, then each bracketed part; blank and repeated ones dropped."""
    c = col(title)
    outside = F.trim(F.regexp_replace(F.regexp_replace(c, r"\([^()]*\)|\[[^\[\]]*\]", " "), r"\s+", " "))
    inside = F.transform(F.regexp_extract_all(c, F.lit(r"[(\[]([^()\[\]]*)[)\]]"), F.lit(1)), lambda x: F.trim(x))
    return F.array_distinct(F.filter(F.concat(F.array(outside), inside), lambda x: x != ""))


def query_key(title, year, director, imdb, minutes, folder=None, lang=None) -> Column:
    parts = [col(title), col(year).cast("string"), col(director), col(imdb), col(minutes).cast("string")]
    return F.concat_ws("|", *parts, *([col(folder)] if folder is not None else []), *([col(lang)] if lang is not None else []))


def decade(year) -> Column:
    return F.expr(f"({year} div 10) * 10") if isinstance(year, str) else (F.floor(year / 10) * 10).cast("int")


def base_name(path) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def parent(path) -> Column:
    return F.regexp_extract(col(path), "^(.*)/[^/]*$", 1)


def stem(path) -> Column:
    """Base name without its last extension."""
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def ext(path) -> Column:
    """Lower-case last extension with its dot, or ''."""
    return F.lower(F.regexp_extract(base_name(path), r"(\.[^.]*)$", 1))


def terms(query) -> Column:
    """Search terms: folded words, none if together they have fewer than two letters or digits."""
    w = words(query)
    return F.when(F.length(F.array_join(w, "")) >= 2, w).otherwise(F.array().cast("array<string>"))


def name_matches(name, query_terms) -> Column:
    """Every term is a word of the name; the last one may be the beginning of a word."""
    w, t = words(name), col(query_terms)
    n = F.size(t)
    whole = F.forall(F.slice(t, 1, F.greatest(n - 1, F.lit(0))), lambda x: F.array_contains(w, x))
    return (n > 0) & whole & F.exists(w, lambda x: x.startswith(F.try_element_at(t, F.lit(-1))))


def list_name(name) -> Column:
    """Trimmed name of 1 to 100 code points, null if it is none."""
    t = F.trim(col(name))
    return F.when(F.length(t).between(1, 100), t)


def ref_movie(tmdb_id) -> Column:
    return F.concat(F.lit("movie:"), col(tmdb_id).cast("string"))


def ref_fingerprint(fp) -> Column:
    return F.concat(F.lit("fp:"), col(fp))


def same_title(a, b) -> Column:
    return F.trim(fold(a)) == F.trim(fold(b))


def image_version(path) -> Column:
    """Base name of a valid image path, else ''."""
    return F.regexp_extract(col(path), r"^/([A-Za-z0-9_-]+)\.(?:jpg|png)$", 1)


def relative_path(path, app_dir: str) -> Column:
    """Path relative to the application folder, with '/' separators; one level up is '../'."""
    p = F.replace(col(path), F.lit("\\"), F.lit("/"))
    top = app_dir.rstrip("/")
    above = top.rpartition("/")[0]
    return F.when(p.startswith(top + "/"), F.substring(p, len(top) + 2, 1 << 30)).when(p.startswith(above + "/"), F.concat(F.lit("../"), F.substring(p, len(above) + 2, 1 << 30))).otherwise(p)


def absolute_path(path, app_dir: str) -> Column:
    p, top = col(path), app_dir.rstrip("/")
    above = top.rpartition("/")[0]
    return F.when(p.startswith("/"), p).when(p.startswith("../"), F.concat(F.lit(above + "/"), F.substring(p, 4, 1 << 30))).otherwise(F.concat(F.lit(top + "/"), p))


def format_size(size) -> Column:
    """1024 steps; one decimal under 10, none above; a comma for decimals."""
    s = col(size).cast("double")
    units = ["B", "KB", "MB", "GB", "TB"]
    out = F.lit(None)
    for i in range(len(units)):
        v = s / float(1024**i)
        text = F.when((v < 10) & F.lit(i > 0), F.replace(F.format_string("%.1f", v), F.lit("."), F.lit(","))).otherwise(F.format_string("%.0f", v))
        out = F.when(s >= float(1024**i) if i else F.lit(True), F.concat(text, F.lit(" " + units[i]))).otherwise(out)
    return out


def format_duration(ms) -> Column:
    m = F.round(col(ms) / 60000).cast("long")
    return F.when(m <= 0, "").when(m < 60, F.concat(m.cast("string"), F.lit(" min"))).when(m % 60 == 0, F.concat((F.floor(m / 60)).cast("string"), F.lit(" h"))).otherwise(F.concat(F.floor(m / 60).cast("string"), F.lit(" h "), (m % 60).cast("string"), F.lit(" min")))


def percent(x) -> Column:
    return F.concat(F.round(col(x) * 100).cast("int").cast("string"), F.lit(" %"))
