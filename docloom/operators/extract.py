"""Rule-based extraction from text and pages."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom import lexicons as L
from docloom.operators.chunking import in_slices


def entity_tags(text: Column, sectors: str = L.SECTORS, policy: str = L.POLICY_TYPES, target: str = L.NET_ZERO) -> Column:
    """struct(years, sectors, has_target, has_policy)."""
    years = F.regexp_extract_all(text, F.lit(r"\b(20[0-9]{2})\b"), F.lit(1))
    years = F.when(text.rlike(r"(?i)\bmid[-\s]?century\b"), F.array_append(years, F.lit("2050"))).otherwise(years)
    found = F.transform(F.regexp_extract_all(F.lower(text), F.lit(rf"\b({sectors})\b"), F.lit(1)), lambda s: F.concat(F.upper(F.substring(s, 1, 1)), F.substr(s, F.lit(2))))
    return F.struct(F.array_sort(F.array_distinct(years)).alias("years"), F.array_sort(F.array_distinct(found)).alias("sectors"), F.lower(text).rlike(target).alias("has_target"), F.lower(text).rlike(policy).alias("has_policy"))


def label(name: str, text: Column, similarity: Column | None = None, least: float = 0.7, sets=L) -> Column:
    """yes, soft_yes, no or low_confidence for one of the labels."""
    t = F.lower(text)
    tags = entity_tags(text, sets.SECTORS, sets.POLICY_TYPES, sets.NET_ZERO)
    if name == "net_zero_target":
        out = F.when(tags["has_target"], "yes")
    elif name == "sector_targets":
        out = F.when(F.size(tags["sectors"]) > 0, "yes")
    elif name == "efficiency_target":
        saves = t.rlike(sets.EFFICIENCY_WORDS)
        out = F.when(tags["has_policy"] & saves & t.rlike(sets.EFFICIENCY_TARGETS), "yes").when(saves, "soft_yes")
    elif name == "electricity_net_zero":
        power = F.contains(t, F.lit("net zero")) & t.rlike(sets.POWER_WORDS)
        out = F.when(power & F.contains(t, F.lit("scenario")), "soft_yes").when(power, "yes")
    elif name == "carbon_pricing":
        out = F.when(t.rlike(sets.CARBON_PRICING), "yes")
    else:
        raise ValueError(name)
    out = out.otherwise("no")
    return out if similarity is None else F.when(similarity < least, "low_confidence").otherwise(out)


def labels_of(df: DataFrame, key: str, text: str, similarity: str | None = None, sets=L) -> DataFrame:
    """key, label, answer: a row for each label."""
    s = F.col(similarity) if similarity else None
    pairs = F.array(*[F.struct(F.lit(n).alias("label"), label(n, F.col(text), s, sets=sets).alias("answer")) for n in sets.LABELS])
    return df.select(key, F.inline(pairs))


class _Markdown(HTMLParser):
    """p, li and h3 in page order; bold as **x**; headings with an id are second-level."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines, self.open, self.text, self.skip, self.lead = [], [], [], 0, ""

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        elif tag in ("p", "li", "h3"):
            self.flush()
            self.open.append(tag)
            self.lead = {"p": "", "li": "- ", "h3": "## " if dict(attrs).get("id") else "### "}[tag]
        elif tag in ("b", "strong") and self.open:
            self.text.append("**")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag in ("p", "li", "h3"):
            self.flush()
            if self.open:
                self.open.pop()
        elif tag in ("b", "strong") and self.open:
            self.text.append("**")

    def handle_data(self, data):
        if self.open and not self.skip:
            self.text.append(data)

    def flush(self):
        line = " ".join("".join(self.text).split())
        if line:
            self.lines.append(self.lead + line)
        self.text = []


def markdown_lines(html: str | None) -> list[str]:
    p = _Markdown()
    p.feed(html or "")
    p.close()
    p.flush()
    return p.lines


def page_markdown(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, line_no, line."""

    schema = pa.schema([(key, pa.int64()), ("line_no", pa.int32()), ("line", pa.string())])
    lines = in_slices(lambda k, h: [(k, i, x) for i, x in enumerate(markdown_lines(h))], schema)
    return pages.select(F.col(key).cast("long").alias(key), html).mapInArrow(lines, f"{key} long, line_no int, line string")


def page_links(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, link: distinct href values."""
    return pages.select(key, F.explode(F.array_distinct(F.regexp_extract_all(html, F.lit(r'href="([^"]*)"'), F.lit(1)))).alias("link"))


def country_links(links: DataFrame, link: str = "link", under: str = "/countries/", slashes: int = 3) -> DataFrame:
    return links.where(F.contains(link, F.lit(under)) & (F.length(link) - F.length(F.replace(F.col(link), F.lit("/"), F.lit(""))) == slashes)).select(link).distinct()


def answer_blocks(df: DataFrame, text: str) -> DataFrame:
    """question, body, url of each third-level heading of a Markdown text."""
    blocks = df.select("*", F.posexplode(F.split(text, r"(?m)^### ")).alias("nth", "block")).where("nth > 0")
    return blocks.withColumn("question", F.trim(F.substring_index("block", "\n", 1))).withColumn("body", F.trim(F.expr("substring(block, length(substring_index(block, '\n', 1)) + 2)"))).withColumn("url", F.regexp_extract("block", r"Source URL: *(\S+)", 1)).drop("block")


def confidences(df: DataFrame, text: str) -> DataFrame:
    """label, confidence of each second-level heading."""
    blocks = df.select("*", F.posexplode(F.split(text, r"(?m)^## ")).alias("nth", "block")).where("nth > 0")
    return blocks.withColumn("label", F.trim(F.substring_index("block", "\n", 1))).withColumn("confidence", F.nullif(F.regexp_extract("block", r"(?i)confidence[^0-9]*([0-9]*\.?[0-9]+)", 1), F.lit("")).cast("double")).drop("block")


def country_of_file(name: Column, countries: list[str]) -> Column:
    """The first country whose name stands in the file name, else the first part in title case if it is longer than two, else Unknown."""
    low = F.lower(name)
    out = None
    for c in countries:
        hit = F.instr(low, c.lower().replace(" ", "_")) > 0
        out = F.when(hit, c) if out is None else out.when(hit, c)
    first = F.split(name, "_")[0]
    tail = F.when(F.length(first) > 2, F.initcap(first)).otherwise("Unknown")
    return tail if out is None else out.otherwise(tail)


def file_parts(name: Column) -> Column:
    """country_language_YYYYMMDD: struct(country, language, date)."""
    p = F.split(F.regexp_replace(name, r"\.[A-Za-z0-9]+$", ""), "_")
    return F.struct(F.initcap(F.get(p, F.lit(0))).alias("country"), F.get(p, F.lit(1)).alias("language"), F.try_to_date(F.get(p, F.lit(2)), "yyyyMMdd").alias("date"))


def month_of_url(url: Column) -> Column:
    """A path segment YYYY-MM as its first day."""
    return F.try_to_date(F.concat(F.get(F.filter(F.split(url, "/"), lambda s: s.rlike(r"^[0-9]{4}-[0-9]{2}$")), F.lit(0)), F.lit("-01")), "yyyy-MM-dd")


def country_code(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"\{(\w+)\}", 1), F.lit(""))


def links_to(links: DataFrame, suffix: str, link: str = "link") -> DataFrame:
    return links.where(F.endswith(F.lower(F.col(link)), F.lit(suffix)))


def coded(df: DataFrame, name: str, codes: dict[str, str], into: str = "code") -> DataFrame:
    """df's rows whose name has a code, with it."""
    named = F.create_map(*[F.lit(v) for kv in codes.items() for v in kv])
    return df.withColumn(into, F.element_at(named, F.col(name))).where(F.col(into).isNotNull())
