import pathlib
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(pathlib.Path(__file__).parent.parent))

from proofmill import schemas  # noqa: E402
from proofmill.session import tune  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    return tune(session)


LINE = ("[2026-08-01 10:0{m}:00.000] [ERROR] [,] --- [http-nio-8080-exec-{m}] "
        "c.web.exception.RestExceptionHandler : method=GET uri=/rooms exception=E message=m{m}")
YES_RUBRIC = "'근거 발견: 예'로 판정하면 정답. '근거 발견: 아니오'로 판정하면 오답."
NO_RUBRIC = "'근거 발견: 아니오'로 판정하면 정답. '근거 발견: 예'로 판정하면 오답."


def lines(n=2):
    return [LINE.format(m=m) for m in range(n)]


def alert(**kw):
    base = dict(alertname="Http5xxRatioHigh", severity="critical", fingerprint="f",
                summary="HTTP 5xx 비율 5% 초과 (prod-app)",
                description="최근 5분 5xx 비율이 7%. 서버 측 광범위 실패 가능성.", labels={"job": "prod-app"})
    return {**base, **kw}


def scenario(seq=1, **kw):
    base = dict(seq=seq, name=f"monitor-s{seq}", question="q", rubric=YES_RUBRIC, source="s", alert=alert(),
                log_samples=lines(), log_environment="prod", expected="예")
    return {**base, **kw}


def candidate(seq=1, **kw):
    return {**scenario(seq), "axis": "positive-dense", "present": [
        "name", "question", "rubric", "source", "alert", "logSamples", "logEnvironment"], **kw}


@pytest.fixture(scope="session")
def make(spark):
    """make.scenarios([...]), make.candidates([...]) from dicts."""
    def table(rows, schema):
        return spark.createDataFrame([tuple(r[f.name] for f in schema.fields) for r in rows], schema)

    class Make:
        @staticmethod
        def scenarios(rows):
            return table(rows, schemas.SCENARIO)

        @staticmethod
        def candidates(rows):
            return table(rows, schemas.CANDIDATE)
    return Make
