"""Session settings and run parameters."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Settings:
    """Defaults of a run; every field can be overridden by spark.conf `quillstream.<field>`."""

    candidate_k: int = 10
    final_k: int = 5
    candidate_grid: tuple[int, ...] = (10, 20, 50)
    final_grid: tuple[int, ...] = (1, 3, 5, 10)
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    rrf_c: int = 60
    target_tokens: int = 450
    max_tokens: int = 650
    embed_batch: int = 32
    upload_batch: int = 100

    def __post_init__(self) -> None:
        if self.candidate_k < self.final_k:
            raise ValueError("candidate_k must not be smaller than final_k")

    @classmethod
    def of(cls, spark: SparkSession) -> "Settings":
        found = {}
        for name, default in asdict(cls()).items():
            if (value := spark.conf.get(f"quillstream.{name}", None)) is not None:
                found[name] = tuple(map(int, value.split(","))) if isinstance(default, tuple) else type(default)(value)
        return cls(**found)

    def snapshot(self, spark: SparkSession) -> DataFrame:
        """The run's settings as one row, to be written beside its results."""
        return spark.createDataFrame([tuple(str(v) for v in asdict(self).values())], list(asdict(self)))


def required(spark: SparkSession, name: str) -> str:
    value = spark.conf.get(name, None)
    if not value:
        raise KeyError(f"{name} is not set")
    return value


def session(app: str = "quillstream", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
