"""The named queries over an uploaded table: upload, profile, charts, models, export, chat."""

from __future__ import annotations

import uuid
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assoc, charts, insights, network, outliers, profile, train
from ..operators.clean import Settings, clean, data_columns
from ..sources.catalog import Catalog, for_json
from ..store import scratch
from ..sources.ingest import ROW_ID, preview, read_delimited, read_parquet, with_row_id


class Analyst:
    def __init__(self, spark: SparkSession, folder: str, model: insights.TextModel | None = None, settings: Settings | None = None):
        self.spark, self.model, self.settings = spark, model, settings or Settings()
        self.catalog = Catalog(spark, folder)

    # about -------------------------------------------------------------------------------------------

    def info(self) -> dict:
        return {"name": "sparkloom", "status": "running", "spark": self.spark.version}

    def health(self) -> dict:
        return {"status": "healthy", "model": self.model is not None, "analyses": len(self.catalog.file_ids())}

    # upload ------------------------------------------------------------------------------------------

    def upload_preview(self, path: str) -> dict:
        """What a file looks like before cleaning."""
        raw = self._read(path)
        return {"rows_count": raw.count(), "columns": self._metadata(raw.drop(ROW_ID)), "preview_data": self._rows(preview(raw, 20))}

    def analyze(self, path: str, filename: str | None = None) -> dict:
        """Read, clean, profile, relate and describe a table, and store all of it, the raw rows too."""
        file_id, version = uuid.uuid4().hex[:8], self.catalog.new_version()
        raw = self.catalog.save_table(file_id, self._read(path), "raw", version)
        return self._analyzed(file_id, filename or path.rsplit("/", 1)[-1], raw, version, self.settings)

    def reclean(self, file_id: str, settings: Settings | None = None) -> dict:
        """Clean the stored raw rows again, with other settings (by default those of the analysis), and store what follows."""
        found = self.get_analysis(file_id)
        settings = settings or Settings(**found.get("cleaning_settings", {}))
        return self._analyzed(file_id, found["filename"], self.catalog.load_table(file_id, "raw"), self.catalog.versions(file_id)["raw"], settings)

    def _analyzed(self, file_id: str, filename: str, raw: DataFrame, raw_version: str, settings: Settings) -> dict:
        version = self.catalog.new_version()
        with scratch(self.spark):
            cleaned, report = clean(raw, settings)
            df = self.catalog.save_table(file_id, cleaned, "cleaned", version)
        payload = self._profile(df) | {"cleaning_report": report.as_dict(), "cleaning_settings": asdict(settings), "rows_raw": report.rows_start}
        payload |= self._insights(payload)
        self.catalog.store(file_id, filename, payload, {"raw": raw_version, "cleaned": version})
        return self.get_analysis(file_id)

    def _read(self, path: str) -> DataFrame:
        return with_row_id(read_parquet(self.spark, path)) if path.rstrip("/").endswith(".parquet") else read_delimited(self.spark, path)

    def _metadata(self, df: DataFrame) -> list[dict]:
        if not df.columns:
            return []
        found = {r["column"]: r.asDict() for r in profile.column_metadata(df).collect()}
        samples = df.limit(200).collect()
        return [found[c] | {"sample_values": [str(r[c]) for r in samples if r[c] is not None][:5]} for c in df.columns]

    @staticmethod
    def _rows(df: DataFrame) -> list[list[str | None]]:
        return [[None if v is None else str(v) for v in r] for r in df.collect()]

    def _profile(self, df: DataFrame) -> dict:
        plain = df.select(*[F.col(f"`{c}`") for c in data_columns(df)])
        fields = {f.name: f for f in plain.schema}
        numbers = [c for c in plain.columns if profile.upload_type(fields[c]) == "numeric"]
        texts = [c for c in plain.columns if profile.upload_type(fields[c]) == "categorical"]
        metadata = self._metadata(plain)
        stats = {}
        for r in profile.numeric_profile(plain, numbers).collect() if numbers else []:
            stats[r["column"]] = r.asDict() | {"type": "numeric"}
        for r in profile.categorical_profile(plain, texts).collect() if texts else []:
            stats[r["column"]] = r.asDict() | {"type": "categorical"}
        for c in stats:
            stats[c]["distribution"] = {str(r["value"]): r["n"] for r in profile.value_counts(plain, c).collect()}
        for c in plain.columns:
            stats.setdefault(c, {"column": c, "type": "unknown"})
        usable = assoc.usable_columns(plain)
        pairs = [r.asDict() for r in assoc.pair_list(plain, usable).collect()] if len(usable) > 1 else []
        kinds = {m["column"]: (profile.cleaned_type(fields[m["column"]]), m["unique_count"]) for m in metadata}
        return {
            "summary": profile.table_summary(plain).first().asDict(), "columns": metadata, "statistics": stats,
            "correlations": {"columns": usable, "pairs": pairs, "summary": f"Found {len(pairs)} pairwise correlations among {len(usable)} numeric columns."},
            "outliers": self._outliers(plain, numbers, texts), "charts": {c: dict(zip(("chart", "reason"), charts.recommended_chart(*k), strict=True)) for c, k in kinds.items()},
            "preview": self._rows(preview(df, 20)),
        }

    @staticmethod
    def _outliers(df: DataFrame, numbers: list[str], texts: list[str]) -> dict:
        out = {r["column"]: r.asDict() | {"is_numeric": True} for r in outliers.iqr_report(df, numbers).collect()} if numbers else {}
        for c in texts:
            rare = outliers.rare_values(df, c).orderBy("n", "value")
            n = rare.agg(F.sum("n")).first()[0]
            if n:
                out[c] = {"column": c, "is_numeric": False, "outlier_count": n, "outlier_values": [r["value"] for r in rare.limit(10).collect()], "note": "rare values"}
        return out

    def _insights(self, payload: dict) -> dict:
        names = payload["correlations"]["columns"]
        return {"insights": insights.dataset_insights(self.model, payload["columns"], payload["summary"]), "correlation_insights": insights.correlation_insights(self.model, self._pairs(payload), names)}

    @staticmethod
    def _pairs(payload: dict) -> list[network.Pair]:
        return [(p["col_a"], p["col_b"], p["r"]) for p in payload["correlations"]["pairs"]]

    # look up -----------------------------------------------------------------------------------------

    def get_analysis(self, file_id: str) -> dict:
        found = self.catalog.get(file_id)
        if found is None:
            raise KeyError(file_id)
        return found

    def list_files(self) -> list[dict]:
        """All analyses, newest first, from one scan."""
        rows = self.catalog.table().select("file_id", "filename", "created_at", F.get_json_object("payload", "$.summary.rows").cast("long").alias("rows"), F.get_json_object("payload", "$.summary.columns").cast("long").alias("columns"))
        return [for_json(r.asDict()) for r in rows.orderBy(F.desc("created_at"), "file_id").collect()]

    def delete(self, file_id: str) -> bool:
        return self.catalog.delete(file_id)

    def column(self, file_id: str, name: str) -> dict:
        found = self.get_analysis(file_id)
        return next(m for m in found["columns"] if m["column"] == name) | {"statistics": found["statistics"][name], "chart": found["charts"][name]}

    def describe(self, file_id: str, name: str) -> dict:
        return self.column(file_id, name) | {"description": insights.column_description(self.model, self.column(file_id, name))}

    def correlations(self, file_id: str) -> dict:
        found = self.get_analysis(file_id)
        return found["correlations"] | {"insights": found["correlation_insights"], "most_important": network.most_important(self._pairs(found), found["correlations"]["columns"]), "scatter": network.scatter_pair(self._pairs(found), found["correlations"]["columns"])}

    def outliers(self, file_id: str) -> dict:
        return self.get_analysis(file_id)["outliers"]

    def charts(self, file_id: str) -> dict:
        return self.get_analysis(file_id)["charts"]

    def insights(self, file_id: str, generate: bool = False) -> dict:
        """The stored insights, or new ones (which are not stored)."""
        found = self.get_analysis(file_id)
        return self._insights(found) if generate else {k: found[k] for k in ("insights", "correlation_insights")}

    # from the cleaned table --------------------------------------------------------------------------

    def cleaned(self, file_id: str) -> DataFrame:
        """The cleaned table; where its files are gone, cleaned again from the raw rows."""
        try:
            return self.catalog.load_table(file_id)
        except KeyError:
            self.reclean(file_id)
            return self.catalog.load_table(file_id)

    def preview(self, file_id: str, rows: int = 5) -> DataFrame:
        return preview(self.cleaned(file_id), rows)

    def series(self, file_id: str, columns: list[str] | None = None) -> DataFrame:
        return charts.series(self.cleaned(file_id).drop(ROW_ID), columns)

    def histogram(self, file_id: str, column: str) -> DataFrame:
        return charts.histogram(self.cleaned(file_id), column)

    def export_csv(self, file_id: str, path: str) -> None:
        self.catalog.export_csv(file_id, path)

    def train(self, file_id: str, target: str | None = None, agent_loop: bool = False) -> dict:
        ask = (lambda prompt: insights.ask_json(self.model, prompt)) if self.model else None
        result = train.train(self.cleaned(file_id).drop(ROW_ID), ask, target, agent_loop)
        return result | {"insights": insights.model_insights(self.model, result)}

    def chat(self, file_id: str, question: str) -> str:
        found = self.get_analysis(file_id)
        answer = insights.chat_answer(self.model, question, found["columns"], found["summary"])
        self.catalog.add_message(file_id, question, answer)
        return answer
