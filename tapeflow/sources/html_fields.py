"""Field extraction from HTML pages and the fundamentals table built on it.

One row function walks a page with the standard parser; everything after it
(matching of names, numbers, pivot, derived ratios) is DataFrame work.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeflow.functions.scalars import clean_number

LINES_SCHEMA = ("page_id bigint, title string, links bigint, "
                "lines array<struct<section:string,row:int,label:string,second:string,last:string,previous:string>>")
TABLES = ("quarters", "profit-loss", "shareholding")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

# Part of a ratio name -> field, first match wins; None skips.
RATIO_FIELDS = (
    ("market cap", "market_cap_cr"), ("current price", None), ("high / low", None), ("stock p/e", "pe_ratio"),
    ("p/e", "pe_ratio"), ("book value", None), ("dividend yield", None), ("roce", "roce"), ("roe", "roe"),
    ("face value", None), ("p/b", "pb_ratio"), ("price to book", "pb_ratio"), ("eps", "eps"),
    ("debt to equity", "debt_equity"), ("d/e", "debt_equity"), ("current ratio", "current_ratio"),
    ("quick ratio", None), ("interest coverage", None), ("sales growth 3years", "revenue_growth_3yr"),
    ("sales growth", "revenue_growth"),
)
HOLDER_FIELDS = (("promoters", "promoter_holding"), ("fii", "fii_holding"), ("dii", "dii_holding"))
FIELDS = ("market_cap_cr", "pe_ratio", "roce", "roe", "pb_ratio", "eps", "debt_equity", "current_ratio",
          "revenue_growth_3yr", "revenue_growth", "revenue_cr", "net_profit_margin", "promoter_holding",
          "fii_holding", "dii_holding")


class _Cells(HTMLParser):
    """Collects (section, row, column, text) of ratio list items, table cells, the title and links."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.cells = [], []
        self.row, self.col, self.buf = -1, 0, None

    def _section(self):
        return next((s for _, s in reversed(self.stack) if s), None)

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "a" and a.get("href"):
            self.cells.append(["link", 0, 0, a["href"]])
        if tag in VOID:
            return
        ident = a.get("id")
        self.stack.append((tag, ident if ident in TABLES or ident == "top-ratios" else None))
        sec, cls = self._section(), (a.get("class") or "").split()
        if sec in TABLES and tag == "tr" or sec == "top-ratios" and tag == "li":
            self.row, self.col = self.row + 1, 0
        elif sec in TABLES and tag == "td":
            self.buf = (sec, self.row, self.col, [], len(self.stack))
            self.col += 1
        elif sec == "top-ratios" and self.buf is None and ("name" in cls or "value" in cls or "number" in cls):
            self.buf = (sec, self.row, 0 if "name" in cls else 1, [], len(self.stack))
        elif tag == "title":
            self.buf = ("title", 0, 0, [], len(self.stack))

    def handle_endtag(self, tag):
        if tag not in [t for t, _ in self.stack]:
            return
        while self.stack:
            if self.buf is not None and len(self.stack) == self.buf[4]:
                sec, row, col, parts, _ = self.buf
                self.cells.append([sec, row, col, "".join(p.strip() for p in parts)])
                self.buf = None
            if self.stack.pop()[0] == tag:
                break

    def handle_data(self, data):
        if self.buf is not None:
            self.buf[3].append(data)


def page_cells(html: str) -> list[list]:
    p = _Cells()
    p.feed(html or "")
    p.close()
    return p.cells


def _lines(found: list[list]) -> list[dict]:
    """Rows of the known sections: first, second, last and second-to-last cell."""
    rows: dict[tuple, list[str]] = {}
    for section, row, _, text in found:
        if section == "top-ratios" or section in TABLES:
            rows.setdefault((section, row), []).append(text)
    return [{"section": s, "row": r, "label": c[0].lower(), "second": c[1] if len(c) > 1 else None, "last": c[-1], "previous": c[-2] if len(c) > 2 else c[-1]}
            for (s, r), c in rows.items()]


def page_lines(pages: DataFrame) -> DataFrame:
    """One row per page: title, number of links and the rows of its known sections."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for pid, html in zip(b["page_id"], b["html"]):
                found = page_cells(html)
                titles = [t for s, _, _, t in found if s == "title"]
                out.append((pid, max(titles) if titles else None, sum(s == "link" for s, *_ in found), _lines(found)))
            yield pd.DataFrame(out, columns=["page_id", "title", "links", "lines"])

    return pages.select("page_id", "html").mapInPandas(run, LINES_SCHEMA)


def _first_match(name, table):
    """Field of the first pattern that names one; entries without a field stand for labels that are skipped and end nothing."""
    out = F
    for part, field in table:
        if field is not None:
            out = out.when(name.contains(part), F.lit(field))
    return out


def _picked(line):
    """Fields that a line names, with its text."""
    label, sec = line["label"], line["section"]

    def one(field, text):
        return F.struct(field.alias("field"), text.alias("text"), line["row"].alias("row"), sec.alias("section"))

    none = F.array().cast("array<struct<field:string,text:string,row:int,section:string>>")
    return (F.when(sec == "top-ratios", F.array(one(_first_match(label, RATIO_FIELDS), line["second"])))
            .when((sec == "quarters") & label.contains("eps"), F.array(one(F.lit("eps_q"), line["last"])))
            .when((sec == "profit-loss") & label.contains("sales"), F.array(one(F.lit("revenue_cr"), line["last"]), one(F.lit("revenue_prev"), line["previous"])))
            .when((sec == "profit-loss") & label.contains("net profit"), F.array(one(F.lit("net_profit"), line["last"])))
            .when(sec == "shareholding", F.array(one(_first_match(label, HOLDER_FIELDS), line["last"])))
            .otherwise(none))


NAMES = (*[f for f in FIELDS if f != "net_profit_margin"], "eps_q", "revenue_prev", "net_profit")


def field_columns(pages: DataFrame) -> DataFrame:
    """One row per page with a column per field. All rows of a page are together, so nothing is shuffled."""
    p = page_lines(pages).withColumn("found", F.flatten(F.transform("lines", _picked)))
    # Ratio and holder lists: the last row of a field wins; tables: the first.
    p = p.withColumn("found", F.filter(F.transform("found", lambda x: F.struct(
        x.field.alias("field"), F.when(x.section.isin("top-ratios", "shareholding"), x.row).otherwise(-x.row).alias("key"), clean_number(x.text).alias("value"))),
        lambda x: x.field.isNotNull() & x.value.isNotNull()))

    def best(name):
        own = F.filter("found", lambda x: x.field == name)
        return F.array_max(F.transform(own, lambda x: F.struct(x.key.alias("key"), x.value.alias("value"))))["value"].alias(name)

    return p.select("page_id", *[best(n) for n in NAMES])


def fields(pages: DataFrame) -> DataFrame:
    """Fundamental fields as rows (page_id, field, value)."""
    return field_columns(pages).unpivot(["page_id"], list(NAMES), "field", "value").filter(F.col("value").isNotNull())


def fundamentals(pages: DataFrame) -> DataFrame:
    """One row per page with data: ratios, growth, margin and holdings."""
    w = field_columns(pages).where(" or ".join(f"{n} is not null" for n in NAMES))
    rev, prev = F.col("revenue_cr"), F.nullif(F.col("revenue_prev"), F.lit(0.0))
    return w.withColumns({
        "eps": F.coalesce("eps_q", "eps"),
        "revenue_growth": F.coalesce((rev / prev - 1) * 100, "revenue_growth"),
        "net_profit_margin": F.try_divide("net_profit", F.nullif(rev, F.lit(0.0))) * 100}).select("page_id", *FIELDS)


def titles_and_links(pages: DataFrame) -> DataFrame:
    """Title and number of links of every page."""
    return page_lines(pages).select("page_id", "title", "links")
