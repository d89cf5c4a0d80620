"""Training job: trips to features, models, calibration and reports."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.eta import naive_eta_min
from ..operators import calibrate, metrics, models
from ..operators.features import build_features, drop_incomplete
from ..operators.histboost import HistBoost, train_boosts
from ..schema import FEATURE_COLS, QUANTILES
from ..session import cut_lineage


@dataclass(frozen=True)
class TrainingOptions:
    """Sizes of the models; the defaults are the full ones."""

    baseline_rounds: int = 200
    specialist_rounds: int = 300
    quantile_rounds: int = 300
    quantile_step: float = 0.05
    depth: int = 6
    quantile_depth: int = 6
    patience: int = 20
    columns: Sequence[str] = tuple(FEATURE_COLS)


@dataclass
class Trained:
    """Models, calibration and near-arrival choice of one training run."""

    quantiles: dict[str, HistBoost]
    baseline: HistBoost
    specialist: HistBoost
    near: models.NearChoice
    calibration: calibrate.Calibration
    columns: Sequence[str] = tuple(FEATURE_COLS)

    def predict(self, rows: DataFrame) -> DataFrame:
        """Add naive, baseline, specialist, quantile and near-arrival predictions."""
        df = rows if "naive" in rows.columns else with_naive(rows)
        df = df.dropna(subset=[*self.columns, "naive"])
        df = self.baseline.predict(self.specialist.predict(df, "specialist"), "baseline")
        df = models.predict_quantiles(self.quantiles, df)
        near = self.near.prediction(F.col("p50"), F.col("naive"), F.col("specialist"))
        return df.withColumn("near_opt", near)

    def save(self, path: str) -> None:
        """Write every model and the choices; nothing fitted is left out."""
        spark = SparkSession.getActiveSession()
        for name, model in self.quantiles.items():
            model.save(f"{path}/{name}")
        self.baseline.save(f"{path}/baseline")
        self.specialist.save(f"{path}/specialist")
        c = self.calibration
        row = [(
            list(self.quantiles), list(self.columns), *asdict(self.near).values(), c.scale_80, c.scale_90,
            c.scale_posthoc, c.buckets.edges, c.buckets.scales, c.qhat,
        )]
        spark.createDataFrame(row, _STATE).coalesce(1).write.mode("overwrite").json(f"{path}/state")

    @classmethod
    def load(cls, path: str) -> Trained:
        spark = SparkSession.getActiveSession()
        s = spark.read.schema(_STATE).json(f"{path}/state").first()
        return cls(
            quantiles={name: HistBoost.load(f"{path}/{name}") for name in s["quantiles"]},
            baseline=HistBoost.load(f"{path}/baseline"),
            specialist=HistBoost.load(f"{path}/specialist"),
            near=models.NearChoice(s["mode"], s["threshold"], s["weight"], s["near_mae"], s["within_tolerance"]),
            calibration=calibrate.Calibration(
                s["scale_80"], s["scale_90"], s["scale_posthoc"],
                calibrate.BucketScales(list(s["edges"]), list(s["scales"])), s["qhat"],
            ),
            columns=list(s["columns"]),
        )


_STATE = (
    "quantiles array<string>, columns array<string>, mode string, threshold double, weight double, "
    "near_mae double, within_tolerance double, scale_80 double, scale_90 double, "
    "scale_posthoc double, edges array<double>, scales array<double>, qhat double"
)


def with_naive(rows: DataFrame) -> DataFrame:
    return rows.withColumn("naive", naive_eta_min(F.col("dist_remaining_km"), F.col("Speed")))


def training_rows(trips: DataFrame, min_pings: int | None = None, exact_split: bool = False) -> DataFrame:
    """Labelled, complete feature rows with the naive estimate ``naive``, label ``y`` and ``split``."""
    rows = drop_incomplete(build_features(trips, min_pings=min_pings, label=True))
    rows = with_naive(rows).withColumn("y", F.col("eta_remaining_min"))
    return models.trip_split(rows, exact=exact_split)


def fit(rows: DataFrame, options: TrainingOptions = TrainingOptions()) -> tuple[Trained, DataFrame]:
    """Train everything on prepared rows; also returns the predicted test rows.

    The rows are written once before the iterative fits; predictions on the validation and test
    rows are written once before they are aggregated several times.
    """
    keep = ["VIN", "trip_local", "event_seq", "Speed", *FEATURE_COLS, "naive", "y", "split"]
    rows = cut_lineage(rows.select(*dict.fromkeys(keep)))
    rows_of = {s: models.with_near_weight(rows.where(F.col("split") == s)) for s in ("train", "validation")}
    baseline = models.baseline_spec("baseline", options.columns, options.baseline_rounds, options.depth)
    specialist = models.specialist_spec([*options.columns, "naive"], options.specialist_rounds, options.depth)
    quantiles = [
        models.quantile_spec(a, options.columns, options.quantile_rounds, options.quantile_depth, options.quantile_step, options.patience)
        for a in QUANTILES
    ]
    fitted = train_boosts(rows_of["train"], rows_of["validation"], [baseline, specialist, *quantiles])
    baseline, specialist = fitted.pop("baseline"), fitted.pop("specialist")
    quantiles = fitted
    start = models.NearChoice("global", 0.0, 0.0, None, None)
    trained = Trained(quantiles, baseline, specialist, start, None, options.columns)
    scored = cut_lineage(trained.predict(rows.where(F.col("split") != "train")))
    held, test = scored.where(F.col("split") == "validation"), scored.where(F.col("split") == "test")
    trained.near = models.choose_near(models.near_candidates(held))
    trained.calibration = calibrate.fit_calibration(held, test)
    near = trained.near.prediction(F.col("p50"), F.col("naive"), F.col("specialist"))
    return trained, test.withColumn("near_opt", near)


def reports(trained: Trained, test: DataFrame) -> dict[str, DataFrame]:
    """Comparison of the models and of the calibrated intervals on the test rows."""
    names = {"naive": "naive", "baseline": "baseline", "quantile_p50": "p50", "near_opt": "near_opt"}
    return {
        "comparison": metrics.model_comparison(test, names),
        "intervals": calibrate.calibration_report(test, trained.calibration),
        "quantile": metrics.evaluate(test, p10="p10", p90="p90"),
    }
