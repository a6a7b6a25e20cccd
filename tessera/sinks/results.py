"""Query results as SPARQL JSON, XML, CSV and TSV, and files of each; lines are made by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _text(c: str) -> Column:
    return F.col(f"`{c}`").cast("string")


def json_bindings(df: DataFrame) -> DataFrame:
    """(value): a binding object a row; unbound variables are left out."""
    fields = [F.when(_text(c).isNotNull(), F.struct(F.lit("literal").alias("type"), _text(c).alias("value"))).alias(c) for c in df.columns]
    return df.select(F.to_json(F.struct(*fields)).alias("value"))


def sparql_json(df: DataFrame) -> str:
    """The whole result document.  For results that fit the driver; ``write`` keeps them distributed."""
    import json

    head = json.dumps({"vars": df.columns})
    return f'{{"head":{head},"results":{{"bindings":[{",".join(r[0] for r in json_bindings(df).toLocalIterator())}]}}}}'


def _xml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def xml_results(df: DataFrame) -> DataFrame:
    cells = [F.when(_text(c).isNotNull(), F.concat(F.lit(f'<binding name="{c}"><literal>'), _xml(_text(c)), F.lit("</literal></binding>"))) for c in df.columns]
    return df.select(F.concat(F.lit("<result>"), F.concat_ws("", *cells), F.lit("</result>")).alias("value"))


def sparql_xml(df: DataFrame) -> str:
    head = "".join(f'<variable name="{c}"/>' for c in df.columns)
    body = "".join(r[0] for r in xml_results(df).toLocalIterator())
    return f'<?xml version="1.0"?><sparql xmlns="http://www.w3.org/2005/sparql-results#"><head>{head}</head><results>{body}</results></sparql>'


def csv_lines(df: DataFrame) -> DataFrame:
    quoted = [F.coalesce(F.when(_text(c).rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(_text(c), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(_text(c)), F.lit("")) for c in df.columns]
    return df.select(F.concat_ws(",", *quoted).alias("value"))


def tsv_lines(df: DataFrame) -> DataFrame:
    cells = [F.coalesce(F.replace(F.replace(F.replace(_text(c), F.lit("\\"), F.lit("\\\\")), F.lit("\t"), F.lit("\\t")), F.lit("\n"), F.lit("\\n")), F.lit("")) for c in df.columns]
    return df.select(F.concat_ws("\t", *cells).alias("value"))


def to_csv(df: DataFrame) -> str:
    return "\r\n".join([",".join(df.columns), *(r[0] for r in csv_lines(df).toLocalIterator())]) + "\r\n"


def to_tsv(df: DataFrame) -> str:
    return "\n".join(["\t".join(f"?{c}" for c in df.columns), *(r[0] for r in tsv_lines(df).toLocalIterator())]) + "\n"


def to_json(df: DataFrame) -> str:
    """An array of one object a row, unbound variables as null.  For results that fit the driver."""
    return "[" + ",\n ".join(r[0] for r in df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("value")).toLocalIterator()) + "]\n"


def to_table(df: DataFrame, rows: int = 50) -> str:
    """A text table of the first rows: a report."""
    cells = [[str(x) if x is not None else "" for x in r] for r in df.limit(rows).collect()]
    if not cells:
        return "No results"
    wide = [max(len(x) for x in col) for col in zip(df.columns, *cells)]
    line = lambda xs: "| " + " | ".join(x.ljust(w) for x, w in zip(xs, wide)) + " |"
    rule = "+" + "+".join("-" * (w + 2) for w in wide) + "+"
    return "\n".join([rule, line(df.columns), rule, *map(line, cells), rule])


def write(df: DataFrame, path: str, format: str = "parquet") -> None:
    """Distributed output: parquet, json, csv, xml, orc, or text lines of tsv."""
    if format == "tsv":
        tsv_lines(df).write.mode("overwrite").text(path)
    elif format == "xml":
        df.write.mode("overwrite").format("xml").option("rowTag", "result").save(path)
    else:
        df.write.mode("overwrite").format(format).options(**({"header": "true"} if format == "csv" else {})).save(path)


def stream(df: DataFrame, progress=None):
    """Rows as dictionaries, a partition at a time; ``progress`` is called with each running count."""
    for n, row in enumerate(df.toLocalIterator(prefetchPartitions=True), 1):
        if progress:
            progress(n)
        yield row.asDict()
