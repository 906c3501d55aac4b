"""Routing of files to record types by declared patterns, keywords and markers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import bounded, glob_pattern


@dataclass(frozen=True)
class Route:
    """A record type with what points to it; of several the higher priority wins."""

    doc_type: str
    priority: int
    path_patterns: tuple[str, ...] = ()
    keywords: tuple[str, ...] = ()
    markers: tuple[str, ...] = ()


# Words in paths, names and texts that point to a type.
ROUTES = (
    Route("salary_deductions", 30, ("*salary_deductions*", "*удержан*зарплат*"), ("удержание", "salary"), ("удерживать из заработка", "постановление об обращении взыскания на заработную плату")),
    Route("executive_documents", 20, ("*executive_documents*", "*исполнит*лист*"), ("исполнительный лист", "судебный приказ"), ("исполнительный лист", "судебный приказ")),
    Route("legal_claims", 19, ("*legal_claims*",), ("претензия", "claim"), ("претензия",)),
    Route("invoices_upd", 16, ("*invoices_upd*", "*счет*фактур*"), ("упд", "invoice"), ("универсальный передаточный документ", "счёт-фактура")),
    Route("commercial_contracts", 15, ("*commercial_contracts*",), ("договор", "contract"), ("договор поставки", "договор подряда")),
    Route("enforcement_orders", 10, ("*enforcement_orders*",), ("фссп", "возбуждение"), ("о возбуждении исполнительного производства",)),
)


def routed(path: Column, text: Column | None = None, routes: tuple[Route, ...] = ROUTES) -> Column:
    """struct(doc_type, confidence, method): path patterns (0.95), then keywords (0.90), then markers in the text (0.92)."""
    ordered = sorted(routes, key=lambda r: -r.priority)
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))

    def hit(route: Route, confidence: float, method: str, cond: Column) -> Column:
        return F.when(cond, F.struct(F.lit(route.doc_type).alias("doc_type"), F.lit(confidence).alias("confidence"), F.lit(method).alias("method")))

    ways = [hit(r, 0.95, "heuristic_path", low.rlike("|".join(map(glob_pattern, r.path_patterns)))) for r in ordered if r.path_patterns]
    ways += [hit(r, 0.90, "heuristic_keyword", low.rlike("|".join(map(bounded, r.keywords)))) for r in ordered if r.keywords]
    if text is not None:
        content = F.lower(text)
        for r in ordered:
            found = F.lit(False)
            for m in r.markers:
                found = found | F.contains(content, F.lit(m.lower()))
            ways.append(hit(r, 0.92, "text_content_marker", found))
    unknown = F.struct(F.lit("unknown").alias("doc_type"), F.lit(0.0).alias("confidence"), F.lit("unknown").alias("method"))
    return F.coalesce(*ways, unknown)


def accuracy(df: DataFrame, truth: str, found: str) -> DataFrame:
    """How many files went to the right type, a wrong one and none, in all and for each type."""
    right, none = F.col(truth) == F.col(found), F.col(found) == "unknown"
    return df.rollup(truth).agg(F.count(F.lit(1)).alias("files"), F.count_if(right).alias("right"), F.count_if(~right & ~none).alias("wrong"), F.count_if(none).alias("unrouted"))
