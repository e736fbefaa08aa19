"""Column functions over text. Patterns keep to what both Java's and RE2's engines read alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]+"
#: Fixed value: characters that count as legitimate.
LEGITIMATE = r"[a-zA-Z0-9àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞß\s.,;:!?()\-'\"]"
CID = r"\(cid:[0-9]+\)"


def squeeze(x: Column) -> Column:
    """White space runs become one space, none at the ends."""
    return F.trim(F.regexp_replace(x, r"\s{2,}|[^\S ]", " "))  # single spaces stay as they are


def whitespace_tokens(x: Column) -> Column:
    """As Python's split() without arguments."""
    return F.array_remove(F.split(x, r"\s+"), "")


def words(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(f"({TOKEN})"), F.lit(1))


def alphabetic(x: Column, least: int = 2, most: int = 15) -> Column:
    """Lower-cased words of letters only, of so many letters."""
    return F.regexp_extract_all(F.lower(x), F.lit(rf"(\b\p{{L}}{{{least},{most}}}\b)"), F.lit(1))


def training_tokens(x: Column) -> Column:
    """Lower-cased, punctuation off, longer than two characters, not digits; texts with three or fewer give none."""
    t = F.filter(whitespace_tokens(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}_\s]", " ")), lambda w: (F.length(w) > 2) & ~w.rlike(r"^[0-9]+$"))
    return F.when(F.size(t) > 3, t).otherwise(F.array().cast("array<string>"))


def sentences(x: Column) -> Column:
    return F.split(F.regexp_replace(x, r"([.!?])\s+", "$1\u0001"), "\u0001")


def _bound(x: Column, f) -> Column:
    """f(x) with x evaluated once: as the variable of a lambda over one element."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def sentence_windows(x: Column, size: int = 3, overlap: int = 1) -> Column:
    """Texts of `size` sentences, each beginning max(1, size - overlap) after the last."""
    step = max(1, size - overlap)
    return _bound(sentences(x), lambda s: F.transform(F.sequence(F.lit(0), F.size(s) - 1, F.lit(step)), lambda i: F.array_join(F.slice(s, i + 1, F.lit(size)), " ")))


def ngrams(x: Column, n: int = 3) -> Column:
    """Word n-grams; a shorter text is its own."""
    grams = lambda t: F.transform(F.sequence(F.lit(0), F.size(t) - n), lambda i: F.array_join(F.slice(t, i + 1, F.lit(n)), " "))
    return _bound(whitespace_tokens(x), lambda t: F.when(F.size(t) < n, F.array(F.array_join(t, " "))).otherwise(grams(t)))


def preprocessed(x: Column, abbreviations=()) -> Column:
    x = F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), r"\s+", " "), r"[^\p{L}\p{N}_\s\-.,:;()%$]", " ")
    for short, full in abbreviations:
        x = F.regexp_replace(x, rf"\b{short}\b", full)
    return x


def usable(x: Column) -> Column:
    """Longer than ten characters, not a number, no list."""
    return x.isNotNull() & (F.length(F.trim(x)) > 10) & ~F.trim(x).rlike(r"^[0-9]+(\.[0-9]+)?$") & ~F.startswith(F.trim(x), F.lit("["))


def skipped_element(x: Column) -> Column:
    """Page furniture: short, page numbers, roman numerals, punctuation."""
    t = F.trim(x)
    return (F.length(t) < 10) | t.rlike(r"^([0-9]+|[ivxlcdmIVXLCDM]+|[^\p{L}\p{N}]+|(?i:page)\s+[0-9]+.*)$")


def cid_count(x: Column) -> Column:
    return F.regexp_count(x, F.lit(CID))


def mildly_corrupted(x: Column) -> Column:
    return cid_count(x) * 10 > F.size(whitespace_tokens(x))


def severely_corrupted(x: Column) -> Column:
    n = F.size(whitespace_tokens(x))
    broken = F.length(x) - F.length(F.replace(x, F.lit("�"), F.lit("")))
    # what is left without them tells how many there are, and no list of them is made
    few = (F.length(x) - F.length(F.regexp_replace(x, f"{LEGITIMATE}+", ""))) / F.length(x) < 0.4
    marked = F.contains(x, F.lit("(cid:")) & (n > 0) & (cid_count(x) / n > 0.3)
    return x.isNull() | (F.length(x) < 10) | marked | ((F.length(x) > 20) & few) | (broken >= 3)


def cleaned(x: Column, runs: bool = True) -> Column:
    """cid marks, replacement and control characters become spaces; runs of over ten of a character shrink to three, except in dotted lines."""
    x = F.regexp_replace(x, CID, " ")
    if runs:
        x = F.when(x.rlike(r"^[^.]*\.{10,}[^.]*$"), x).otherwise(F.regexp_replace(x, r"(?s)(.)\1{10,}", "$1$1$1"))
    x = F.replace(x, F.lit("�"), F.lit(" "))
    return squeeze(F.regexp_replace(x, r"[\x00-\x08\x0E-\x1F\x7F]", " "))


def _tidied(x: Column, runs: bool = True) -> Column:
    y = cleaned(x, runs)
    for mark in "•|¦":
        y = F.replace(y, F.lit(mark), F.lit(""))
    for c in ".,;:!?":
        y = F.replace(F.replace(y, F.lit(c * 3), F.lit(c)), F.lit(f"{c} {c}"), F.lit(c))
    return F.trim(y)


def without_gibberish(x: Column, runs: bool = True) -> Column:
    """The cleaned text, or null if it is rejected."""
    y = _tidied(x, runs)
    return F.when(~severely_corrupted(x) & (F.length(y) > 5), y)


def gibberish_dropped(df: DataFrame, text: str, into: str, runs: bool = True) -> DataFrame:
    """df's rows whose text isn't rejected, with the cleaned text. A filter on that text would make the engine clean every text twice: three words
    in a row, which cleaning leaves, tell that enough is left, and only other texts are cleaned to know it."""
    x = F.col(text)
    enough = x.rlike(r"[a-zA-Z]{2,}\s+[a-zA-Z]{2,}\s+[a-zA-Z]{2,}") | (F.length(_tidied(x, runs)) > 5)
    return df.where(~severely_corrupted(x) & enough).withColumn(into, _tidied(x, runs))


def capitalised(x: Column) -> Column:
    return F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substr(x, F.lit(2))))


def shortened(x: Column, most: int = 200) -> Column:
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most), F.lit("..."))).otherwise(x)


def tag(x: Column) -> Column:
    """Safe for a label: other characters become underscores."""
    return F.regexp_replace(x, r"[^a-zA-Z0-9_-]", "_")


def file_name(x: Column) -> Column:
    return F.replace(F.trim(F.regexp_replace(x, r"[^\p{L}\p{N} _-]", "")), F.lit(" "), F.lit("_"))


def verdict(x: Column, whole_word: bool = False) -> Column:
    """YES, NO or UNCLEAR; any NO wins, in the loose form also inside a word."""
    u = F.upper(x)
    yes, no = (u.rlike(r"\bYES\b"), u.rlike(r"\bNO\b")) if whole_word else (F.contains(u, F.lit("YES")), F.contains(u, F.lit("NO")))
    return F.when(yes & ~no, "YES").when(no, "NO").otherwise("UNCLEAR")


def _among(values: list[str]):
    return lambda w: w.isin(values)


def stop_word_language(x: Column, votes: dict[str, list[str]], default: str = "en") -> Column:
    """The language most of whose words stand in the text; ties and no vote go to the first named."""
    t = words(F.lower(x))
    counts = [(name, F.size(F.filter(t, _among(v)))) for name, v in votes.items()]
    best = F.greatest(*[c for _, c in counts]) if len(counts) > 1 else counts[0][1]
    out = F.when(best == 0, default)
    for name, c in counts:
        out = out.when(c == best, name)
    return out


def main_question(x: Column, separators=("\n", " - ", "; ", ": ")) -> Column:
    """Up to the first separator, with one question mark."""
    for s in separators:
        x = F.substring_index(x, s, 1)
    return F.concat(F.rtrim(F.trim(x), F.lit("?")), F.lit("?"))


def json_object(x: Column) -> Column:
    """From the first { to the last }."""
    first, last = F.instr(x, "{"), F.length(x) - F.instr(F.reverse(x), "}") + 1
    return F.when((first > 0) & (F.instr(x, "}") > 0) & (last >= first), F.substring(x, first, last - first + 1))


def unwrapped(x: Column, field: str) -> Column:
    """A field of a JSON object that stands in the text, whole or as a string inside another object's field; else the text without its marks."""
    inner = F.get_json_object(x, f"$.{field}")
    deeper = F.get_json_object(inner, f"$.{field}")
    return F.coalesce(deeper, inner, squeeze(F.regexp_replace(x, r'[{}"]', " ")))


def sections(x: Column, mark: str = r"Q[0-9]+:") -> Column:
    """What follows each mark, up to the next."""
    parts = F.split(x, mark)
    return F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))


def file_key(name: Column) -> Column:
    """A country's name for keys of files: underscores are spaces, words in title case."""
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def resolved_language(given: Column, file: Column, country: Column, by_country: dict[str, str], known=("en", "de", "fr", "es", "it", "pt", "zh", "ja", "ru")) -> Column:
    """The language that is given, else a known code between underscores of the file's name, else the country's, else English."""
    token = F.nullif(F.regexp_extract(file, rf"_({'|'.join(known)})_", 1), F.lit(""))
    named = F.create_map(*[F.lit(v) for kv in by_country.items() for v in kv])
    return F.coalesce(given, token, F.element_at(named, F.lower(country)), F.lit("en"))


def labelled(index: Column, labels: list[str]) -> Column:
    """The label at a place from 0, or null."""
    return F.get(F.array(*[F.lit(x) for x in labels]), index.cast("int"))
