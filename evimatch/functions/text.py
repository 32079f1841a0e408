"""Reading signals out of text: folding, similarity, numbers, years, names.  Catalyst expressions throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evimatch.functions import vocabulary as v

NUMBER = r"([A-Z]{0,3}\d{1,4}[a-z]?)\s*/\s*([A-Z]{0,3}\d{1,4})"
YEAR = r"(?<![A-Za-z0-9_])(19[3-9]\d|20[0-4]\d)(?![A-Za-z0-9_])"
ABOUT_ANOTHER = r"(?i)(?<![A-Za-z0-9_])(?:evolves?\s+(?:from|de|aus)|put\s+.+\s+on\s+the|entwickelt|[eé]volue)(?![A-Za-z0-9_])"
_WORD = r"^[A-Za-zÀ-ÿ][A-Za-zÀ-ÿ'’.\-]*$"
_LABEL = r"(?i)^(?:basic|stage|stufe|grundphase|phase|niveau|pok[eé]mon|trainer|dresseur|hp|ps|pv|lp)$"
_SUFFIX = r"(?i)^(?:ex|gx|v|vmax|vstar|vunion|break|prime|star)$"
_TITLE = r"(?i)^(?:mr|dr|jr)\.?$"
_SHORT = r"(?i)^(?:mew|muk|ho-oh)$"
#: A _WORD that is no _LABEL and has four letters or signs, or is a _SUFFIX, a _TITLE or _SHORT; and what alone makes no name.
_inner = lambda p: "(?i:" + p.removeprefix("(?i)^").removesuffix("$") + ")"
_TOKEN = rf"^(?!{_inner(_LABEL)}$)(?:[A-Za-zÀ-ÿ][A-Za-zÀ-ÿ'’.\-]{{3,}}|{_inner(_SUFFIX)}|{_inner(_TITLE)}|{_inner(_SHORT)})$"
_ADDED = rf"^(?:{_inner(_SUFFIX)}|{_inner(_TITLE)})$"


def let(c: Column, use) -> Column:
    """use(c) with c worked out once, however often use() names it."""
    return F.transform(F.array(c), use)[0]


def missing(c: Column) -> Column:
    """'' and null are one and the same."""
    return F.nullif(c.cast("string"), F.lit(""))


#: Any letter that _bare() changes.
_ACCENTED = "[\u00c0-\u024f\u0300-\u036f\u1e00-\u1eff]"


#: Any white space but single blanks.
_UNEVEN = r"[\t\n\x0B\f\r]|  |" + v.SPACES.replace(r"\s", "").removesuffix("+")


def _bare(s: Column) -> Column:
    """A text without accents.  Letter by letter is dear, and most texts are spared it: as many bytes as characters, or no such letter."""
    return F.when((F.length(s) == F.octet_length(s)) | ~s.rlike(_ACCENTED), s).otherwise(F.translate(s, v.ACCENTED, v.PLAIN))


def fold(c: Column) -> Column:
    """Lower case without accents, straight quotes unified, white space single and trimmed.  Null folds to ''.

    Exact for Latin letters; other scripts keep their marks.
    """
    s = F.coalesce(c.cast("string"), F.lit(""))
    quotes = lambda x: F.replace(F.replace(x, F.lit("`"), F.lit("'")), F.lit("´"), F.lit("'"))
    return F.lower(F.trim(let(quotes(_bare(s)), lambda x: F.when(x.rlike(_UNEVEN), F.regexp_replace(x, v.SPACES, " ")).otherwise(x))))


def fold_de(c: Column) -> Column:
    return F.replace(fold(c), F.lit("ß"), F.lit("ss"))


def digits_only(c: Column) -> Column:
    return F.translate(c, v.CONFUSED, v.CONFUSED_AS)


def similarity_folded(s: Column, t: Column) -> Column:
    """1 - edits / longer length of two folded texts; 0 if one is empty or the lengths differ by more than half."""
    longest, gap = F.greatest(F.length(s), F.length(t)), F.abs(F.length(s) - F.length(t))
    near = F.lit(1.0) - F.levenshtein(s, t) / longest
    return F.when((s == "") | (t == ""), 0.0).when(s == t, 1.0).when(gap * 2 > longest, 0.0).otherwise(near)


def similarity(a: Column, b: Column) -> Column:
    return let(F.struct(fold(a).alias("a"), fold(b).alias("b")), lambda x: similarity_folded(x["a"], x["b"]))


def contains_fuzzy(haystack: Column, needle: Column) -> Column:
    """How well the needle appears inside the haystack: 1 if contained, else the best window one shorter to one longer."""
    return let(F.struct(fold(haystack).alias("h"), fold(needle).alias("n")), lambda x: _contains_folded(x["h"], x["n"]))


def _contains_folded(h: Column, n: Column) -> Column:
    size = F.length(n)

    def windows(k: Column) -> Column:
        starts = F.when(F.length(h) >= k, F.sequence(F.lit(1), F.length(h) - k + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: let(F.trim(F.substring(h, i, k)), lambda w: similarity_folded(w, n)))

    best = F.array_max(F.concat(windows(size - 1), windows(size), windows(size + 1)))
    return F.when((h == "") | (n == ""), 0.0).when(h.contains(n), 1.0).when(size < 4, 0.0).otherwise(F.coalesce(best, F.lit(0.0)))


def lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\r?\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def repaired(c: Column) -> Column:
    """Pipes and backslashes between digit-like letters become slashes, then confused letters become digits; same length."""
    return digits_only(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?<=[\dOoQDIlSsBZzGT])[|\\](?=[\dOoQDIlSsBZzGT])", "/"))


def card_numbers(c: Column) -> Column:
    """All numbers like 4/102 as structs (numerator, denominator), zeroes kept."""
    found = F.regexp_extract_all(repaired(c), F.lit(NUMBER), F.lit(0))  # one pass: neither part holds a slash or white space

    def parts(m: Column) -> Column:
        bare = F.regexp_replace(m, r"\s+", "")
        return F.struct(F.substring_index(bare, "/", 1).alias("numerator"), F.substring_index(bare, "/", -1).alias("denominator"))

    return F.transform(found, parts)


def denominator(c: Column) -> Column:
    return F.try_to_number(F.regexp_replace(c, r"\D", ""), F.lit("9999")).cast("int")


def pick_number(c: Column, known: Column | None = None) -> Column:
    """The first number whose denominator is a known total (an array of them), else the first; denominators below 5 do not count."""
    return choose_number(card_numbers(c), known)


def choose_number(found: Column, known: Column | None = None) -> Column:
    """pick_number() of numbers as card_numbers() gives them."""
    size = lambda x: denominator(x["denominator"])

    def choose(numbers: Column) -> Column:
        if known is None:
            return F.try_element_at(numbers, F.lit(1))
        of_sets = F.filter(numbers, lambda x: F.coalesce(F.array_contains(known, size(x)), F.lit(False)))
        return F.coalesce(F.try_element_at(of_sets, F.lit(1)), F.try_element_at(numbers, F.lit(1)))

    plausible = F.filter(found, lambda x: ~F.coalesce(size(x) < 5, F.lit(False)))
    return let(let(plausible, choose), lambda x: F.concat(x["numerator"], F.lit("/"), x["denominator"]))


def number_spans(c: Column) -> Column:
    """card_numbers() with place (from 0) and raw, the text as it was read: the repair keeps every character's place."""
    text = F.coalesce(c, F.lit(""))

    def walk(fixed: Column) -> Column:
        found = F.regexp_extract_all(fixed, F.lit(NUMBER), F.lit(0))
        start = F.struct(F.lit(0).alias("from"), F.array().cast("array<struct<place:int,raw:string>>").alias("all"))

        def step(a: Column, m: Column) -> Column:
            at = a["from"] + F.instr(fixed.substr(a["from"] + 1, F.length(fixed)), m) - 1
            return F.struct((at + F.length(m)).alias("from"), F.array_append(a["all"], F.struct(at.alias("place"), text.substr(at + 1, F.length(m)).alias("raw"))).alias("all"))

        return F.aggregate(found, start, step)["all"]

    return let(repaired(c), walk)


def years(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(YEAR), F.lit(1)), lambda x: x.cast("int"))


def latest_year(c: Column) -> Column:
    return F.array_max(years(c))


def copyright_year(c: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), r"(?i)(?:©|\(c\)|copyright)\s*([0-9]{4})?", 1), F.lit("")).cast("int")


def copyright_holder(c: Column) -> Column:
    return missing(F.trim(F.regexp_extract(F.coalesce(c, F.lit("")), r"(?i)(?:©|\(c\)|copyright)\s*([0-9]{4})?\s*([A-Za-zÀ-ÿ'.\- ]{2,40})?", 2)))


def variant_terms(c: Column) -> Column:
    """Canonical variant terms that the text says; a reverse holo is not also a holo."""
    return let(fold(c), variants_folded)


def variants_folded(f: Column) -> Column:
    hits = []
    for name, aliases in v.VARIANTS:
        said = f.contains(aliases[0])
        for a in aliases[1:]:
            said = said | f.contains(a)
        hits.append(F.when(said, F.lit(name)))
    found = F.filter(F.array(*hits), lambda x: x.isNotNull())
    return F.when(F.array_contains(found, "reverse holo"), F.array_remove(found, "holo")).otherwise(found)


def language(c: Column, folded: Column | None = None) -> Column:
    """The language that a text hints at; folded is its fold(), if there is one already."""
    return F.when(F.coalesce(c, F.lit("")).rlike("[぀-ヿ一-龯]"), F.lit("ja")).otherwise(let(fold(c), _language_folded) if folded is None else _language_folded(folded))


def _language_folded(f: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for code, hints in v.LANGUAGE_HINTS:
        said = f.contains(hints[0])
        for h in hints[1:]:
            said = said | f.contains(h)
        out = out.when(said, F.lit(code))
    return out


def hp(c: Column) -> Column:
    text = F.coalesce(c, F.lit(""))
    before = F.regexp_extract(text, r"(?i)(?<![A-Za-z0-9_])(?:HP|PS|PV|LP)\s*[:.]?\s*(\d{2,3})(?![A-Za-z0-9_])", 1)
    after = F.regexp_extract(text, r"(?i)(?<![A-Za-z0-9_])(\d{2,3})\s*(?:HP|PS|PV|LP)(?![A-Za-z0-9_])", 1)
    n = F.coalesce(F.nullif(before, F.lit("")), F.nullif(after, F.lit(""))).cast("int")
    return F.when(n.between(10, 340) & (n % 10 == 0), n)


def _name_tokens(line: Column) -> Column:
    bare = F.transform(F.split(line, r"\s+"), lambda t: F.regexp_replace(t, r"^[^A-Za-zÀ-ÿ0-9]+|[^A-Za-zÀ-ÿ0-9.'’]+$", ""))
    return F.filter(bare, lambda t: t.rlike(_TOKEN))


def pick_name(c: Column) -> Column:
    """The likeliest name in the first eight lines: place counts more than length; the earlier line wins a tie."""
    read = F.transform(F.slice(lines(c), 1, 8), lambda line, i: F.struct(i.alias("i"), F.when(~line.rlike(ABOUT_ANOTHER), _name_tokens(line)).alias("tokens")))
    names = F.filter(read, lambda x: F.exists(x["tokens"], lambda t: ~t.rlike(_ADDED)))

    def scored(x: Column) -> Column:
        value = F.array_join(x["tokens"], " ")
        size = F.least(F.length(F.regexp_replace(value, "[^A-Za-zÀ-ÿ]", "")), F.lit(12))
        return F.struct((F.lit(10.0) - x["i"] * 2.5 + size * 0.3).alias("score"), (-x["i"]).alias("place"), value.alias("value"))

    return F.array_max(F.transform(names, scored))["value"]


def without_evolution_lines(c: Column) -> Column:
    return F.array_join(F.filter(lines(c), lambda x: ~x.rlike(ABOUT_ANOTHER)), "\n")


def query_name(c: Column) -> Column:
    n = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    return F.when(F.length(F.regexp_replace(n, "[^A-Za-zÀ-ÿ]", "")) >= 4, n)


def number_parts(c: Column) -> dict[str, Column]:
    """prefix, num and den of a number like SV049/122; num is null where it does not parse."""
    pattern = r"^([A-Za-z]*)0*(\d+)([a-z]?)(?:\s*/\s*([A-Za-z]*)0*(\d+))?$"
    s = F.trim(F.coalesce(c, F.lit("")))
    part = lambda i: F.regexp_extract(s, pattern, i)
    return {"prefix": F.lower(part(1)), "num": F.nullif(part(2), F.lit("")).cast("bigint"), "den": F.nullif(part(5), F.lit("")).cast("bigint")}


def compare_numbers(a: Column, b: Column) -> Column:
    """1 same printing, 0.6 same place in another set size, 0.85 if a size is missing, 0 otherwise."""
    return compare_parts(number_parts(a), number_parts(b), fold(a) == fold(b))


def compare_parts(x: dict[str, Column], y: dict[str, Column], same_text: Column) -> Column:
    unparsed = x["num"].isNull() | y["num"].isNull()
    sizes = F.when(x["den"].isNull() | (x["den"] == 0) | y["den"].isNull() | (y["den"] == 0), 0.85).when(x["den"] == y["den"], 1.0).otherwise(0.6)
    return F.when(unparsed, F.when(same_text, 1.0).otherwise(0.0)).when((x["num"] == y["num"]) & (x["prefix"] == y["prefix"]), sizes).otherwise(0.0)


def letters(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-zÀ-ÿ0-9]", ""))


def same_name(a: Column, b: Column) -> Column:
    return same_letters(letters(a), letters(b))


def same_letters(x: Column, y: Column) -> Column:
    """Two names as letters() gives them: equal, one inside the other, or few edits apart.  Edits are counted only where lengths allow."""
    short, long = F.least(F.length(x), F.length(y)), F.greatest(F.length(x), F.length(y))
    near = (long >= 7) & (F.lit(1.0) - (long - short) / long >= 0.85)
    close = F.when(near, F.lit(1.0) - F.levenshtein(x, y) / long >= 0.85).otherwise(False)
    return F.when(short < 4, False).when(x == y, True).when((short >= 5) & (x.contains(y) | y.contains(x)), True).otherwise(close)


def clean_word(c: Column) -> Column:
    """A recognised word without the marks around it; signs of a sentence at its end go too, but for a single full stop."""
    begun = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"^[^A-Za-z0-9À-ÿ#©]+", "")
    ended = F.regexp_replace(begun, r"[^A-Za-z0-9À-ÿ.!?]+$", "")
    return let(ended, lambda x: F.when(x.rlike(r"(^|[^.!?])\.$"), x).otherwise(F.regexp_replace(x, r"[.!?]+$", "")))


def plain(c: Column) -> Column:
    bare = F.lower(_bare(F.coalesce(c, F.lit(""))))
    return F.trim(F.regexp_replace(bare, r"[^a-z0-9&'.\-©#/]+", " "))


def name_likeness(c: Column) -> Column:
    """How much a line looks like a person's name, 0..1."""
    t = F.trim(F.coalesce(c, F.lit("")))
    tokens = F.split(t, r"\s+")
    n_letters = F.length(F.regexp_replace(t, "[^A-Za-zÀ-ÿ]", ""))
    marks = F.length(F.regexp_replace(t, r"[\s'’.\-]", ""))
    bad = (t == "") | (F.size(tokens) > 4) | (n_letters < 4) | (n_letters * 10 < marks * 9)
    bad = bad | F.exists(tokens, lambda x: ~x.rlike(_WORD)) | ~F.exists(tokens, lambda x: F.length(F.regexp_replace(x, "[^A-Za-zÀ-ÿ]", "")) >= 3)
    cased = (t == F.upper(t)) | F.forall(tokens, lambda x: x.rlike("^[A-ZÀ-Þ]"))
    base = F.when(cased, 0.7).otherwise(0.3)
    return F.when(bad, 0.0).when(F.size(tokens) >= 2, F.least(F.lit(1.0), base + 0.3)).otherwise(base)


def is_vocabulary(p: Column) -> Column:
    """Whether a word, as plain() gives it, is a maker's, a product's, a league's, a finish's or another word that is no name."""
    known = [w.lower() for w in [*v.MANUFACTURERS, *v.PRODUCTS, *v.LEAGUES, *v.FINISHES, *v.NOT_A_NAME]]
    return p.isin(*sorted(set(known)))


def tidy_name(c: Column) -> Column:
    """The text from its first to its last word that can belong to a name: no lone letter without a full stop, no vocabulary."""
    words = F.filter(F.split(F.trim(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: w != "")

    def holds(w: Column) -> Column:
        n = F.length(F.regexp_replace(w, "[^A-Za-zÀ-ÿ]", ""))
        return (n > 1) | ((n == 1) & w.contains("."))

    def cut(ws: Column) -> Column:
        places = F.filter(F.transform(ws, lambda w, i: F.when(holds(w) & ~is_vocabulary(plain(w)), i)), lambda i: i.isNotNull())
        return let(places, lambda at: F.when(F.size(at) > 0, F.array_join(F.slice(ws, F.array_min(at) + 1, F.array_max(at) - F.array_min(at) + 1), " ")).otherwise(""))

    return let(words, cut)
