"""Outputs: tables, FASTQ by barcode, JSON, HTML."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import seq as S


def write_tsv(df: DataFrame, path: str, sep: str = "\t") -> None:
    df.write.mode("overwrite").csv(path, sep=sep, header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_assignments(assigned: DataFrame, folder: str, ambiguous: str = "keep") -> None:
    """assignments, ambiguous and unmatched rows; ``ambiguous="discard"`` leaves them out of the first."""
    cols = [c for c in ("read_id", "observed", "status", "target_index", "target_id", "best_distance", "second_best_distance", "match_count", "edit_kind") if c in assigned.columns]
    df = assigned.select(*cols)
    write_tsv(df if ambiguous == "keep" else df.where("status <> 'ambiguous'"), f"{folder}/assignments")
    write_tsv(df.where("status = 'ambiguous'"), f"{folder}/ambiguous")
    write_tsv(df.where("status in ('none', 'invalid')"), f"{folder}/unmatched")


def fastq_text(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.concat_ws("\n", "header", "seq", F.coalesce("plus", F.lit("+")) if "plus" in df.columns else F.lit("+"), "qual"))


def write_fastq_by_barcode(assigned: DataFrame, path: str, undetermined: bool = True, compression: str = "none") -> None:
    """A folder of FASTQ for each barcode (``barcode=<safe id>``), and one for the rest."""
    name = F.when(F.col("status") == "unique", S.safe_name("target_id")).otherwise("undetermined")
    df = fastq_text(assigned).withColumn("barcode", name)
    if not undetermined:
        df = df.where("barcode <> 'undetermined'")
    df.select("value", "barcode").write.mode("overwrite").partitionBy("barcode").option("compression", compression).text(path)


def write_bcl_fastq(named: list[tuple[str, DataFrame]], path: str, lane: int = 1) -> None:
    """gzip FASTQ by sample and read: ``sample=<id>_S<n>_L00<lane>_<read>_001``."""
    for read, df in named:
        out = F.concat(S.safe_name(F.coalesce("sample_id", F.lit("Undetermined"))), F.lit("_S"), F.coalesce(F.col("output") + 1, F.lit(0)), F.lit(f"_L{lane:03d}_{read}_001"))
        value = F.concat_ws("\n", F.concat(F.lit("@"), F.col("tile"), F.lit(":"), F.col("cluster")), "seq", F.lit("+"), "qual")
        df.select(value.alias("value"), out.alias("sample")).write.mode("overwrite").partitionBy("sample").option("compression", "gzip").text(f"{path}/{read}")


def html_report(title: str, tables: dict[str, DataFrame], rows: int = 200) -> str:
    """A page with small tables (each cut at ``rows``, as a report is); every value is escaped."""
    esc = lambda v: html.escape("" if v is None else str(v))
    out = [f"<!doctype html><meta charset=utf-8><title>{esc(title)}</title><h1>{esc(title)}</h1>"]
    for name, df in tables.items():
        head = "".join(f"<th>{esc(c)}" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{esc(v)}" for v in r) for r in df.limit(rows).collect())
        out.append(f"<h2>{esc(name)}</h2><table><tr>{head}{body}</table>")
    return "\n".join(out)


def multiqc(section: str, df: DataFrame, key: str = "sample") -> str:
    """Metrics of a few samples as a custom-content section (YAML, of which JSON is a part)."""
    data = {str(r[key]): {k: v for k, v in r.asDict().items() if k != key} for r in df.collect()}
    return f"id: {json.dumps(section)}\nplot_type: generalstats\ndata: {json.dumps(data, default=float)}\n"


def plate_svg(wells: list[tuple[str, str]], cell: int = 60) -> str:
    out = []
    for well, name in wells:
        x, y = (int(well[1:]) - 1) * cell, (ord(well[0]) - 65) * cell
        out.append(f'<rect x="{x}" y="{y}" width="{cell}" height="{cell}" fill="none" stroke="#888"/><text x="{x + 4}" y="{y + 20}" font-size="11">{html.escape(name)}</text>')
    return f'<svg xmlns="http://www.w3.org/2000/svg">{"".join(out)}</svg>'


def picklist(wells: list[tuple[str, str]], plate: str = "P1") -> list[tuple[str, str, str]]:
    return [(plate, well, name) for well, name in wells]
