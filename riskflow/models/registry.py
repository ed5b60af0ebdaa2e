"""Model parameter tables (S11), presence checks (S12) and the training-run log.

Parameters are small (weights, node arrays) and are stored as one-row (or
node-row) Parquet tables under ``<root>/<name>/version=<n>``; versions that are saved
together are rows of one table, ``<root>/_sets/<name>/set=<id>``.  Of a version saved twice the
newer row counts.  Which versions are
live is in a commit log, ``<root>/_live/<n>.json`` (M11: promotion adds an entry,
a rollback adds none): an entry is a file that is moved into place and holds the
live version of every model, so all members of a model set move at once, and
an entry whose number is taken is made again from the newer state, so of two
writers neither loses its change.  The root can be any shared filesystem the
cluster sees.
"""

from __future__ import annotations

import json
import datetime as dt
import uuid
from dataclasses import asdict
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskflow.contract import FEATURES_V1
from riskflow.session import checkpoint_dir


def default_root(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/registry"


def read_or_none(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """The Parquet table at ``path``; None if there is no such folder.  Any other failure raises."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


PARAMS = "name string, version long, model_type string, params string, created_at timestamp"
PARAMS_COLUMNS = ["name", "version", "model_type", "params", "created_at"]


class ModelRegistry:
    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = (root or default_root(spark)).rstrip("/")

    def _path(self, name: str, version: int | None = None) -> str:
        return f"{self.root}/{name}" + (f"/version={version}" if version is not None else "")

    def save(self, name: str, version: int, model_type: str, params: dict) -> None:
        row = [(name, int(version), model_type, json.dumps(params), dt.datetime.now(dt.timezone.utc).replace(tzinfo=None))]
        self.spark.createDataFrame(row, PARAMS).coalesce(1).write.mode("overwrite").parquet(self._path(name, version))

    def save_all(self, name: str, model_type: str, made: list[tuple[int, dict]]) -> None:
        """Several versions in one write, a folder of its own; versions that are there already are replaced by the newer rows."""
        now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        rows = [(name, int(v), model_type, json.dumps(p), now) for v, p in made]
        self.spark.createDataFrame(rows, PARAMS).coalesce(1).write.parquet(f"{self._sets(name)}/set={uuid.uuid4().hex}")

    def _sets(self, name: str) -> str:
        return f"{self.root}/_sets/{name}"

    def _saved(self, name: str) -> DataFrame | None:
        """All saved rows of a model, whichever way they were saved."""
        got = [df.select(*PARAMS_COLUMNS) for df in (read_or_none(self.spark, p, PARAMS) for p in (self._path(name), self._sets(name))) if df is not None]
        return reduce(DataFrame.unionByName, got) if got else None

    def versions(self, name: str) -> list[int]:
        df = self._saved(name)
        return [] if df is None else sorted(int(r[0]) for r in df.select("version").distinct().collect())

    def load(self, name: str, version: int | None = None) -> dict:
        v = self.live_version(name) if version is None else version
        df = None if v is None else self._saved(name)
        r = None if df is None else df.where(F.col("version") == v).orderBy(F.col("created_at").desc()).first()
        if r is None:
            raise FileNotFoundError(f"Missing trained model artifact(s): {name}")
        return {"name": name, "version": v, "model_type": r["model_type"], "params": json.loads(r["params"])}

    def set_live(self, name: str, version: int) -> None:
        self.set_live_all({name: version})

    def set_live_all(self, versions: dict[str, int]) -> None:
        """Make these versions live in one entry of the commit log."""
        while True:
            seq, live = self._last_entry()
            if self._commit(seq + 1, live | {k: int(v) for k, v in versions.items()}):
                return

    def _folder(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/_live")
        return jvm, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _last_entry(self) -> tuple[int, dict[str, int]]:
        """Number and content of the newest entry; -1 and nothing before the first."""
        jvm, fs, path = self._folder()
        if not fs.exists(path):
            return -1, {}
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        last = max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith(".")), default=-1)
        if last < 0:
            return -1, {}
        stream = fs.open(jvm.org.apache.hadoop.fs.Path(path, f"{last}.json"))
        try:
            return last, json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, seq: int, live: dict[str, int]) -> bool:
        """Write entry ``seq`` whole, or find that it is taken."""
        jvm, fs, path = self._folder()
        fs.mkdirs(path)
        draft = jvm.org.apache.hadoop.fs.Path(path, f".{uuid.uuid4().hex}.tmp")
        out = fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(live, sort_keys=True).encode()))
        finally:
            out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        qualified = lambda p: fs.makeQualified(p)
        try:
            context.rename(qualified(draft), qualified(jvm.org.apache.hadoop.fs.Path(path, f"{seq}.json")), none)  # fails if the entry is there
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
            fs.delete(draft, False)
            return False

    def live_version(self, name: str) -> int | None:
        live = self._last_entry()[1].get(name)
        if live is not None:
            return live
        vs = self.versions(name)
        return vs[-1] if vs else None

    def validate(self, names: list[str]) -> dict[str, bool]:
        """Presence of each named model."""
        return {n: bool(self.versions(n)) for n in names}

    def require(self, names: list[str]) -> None:
        missing = [n for n, ok in self.validate(names).items() if not ok]
        if missing:
            raise FileNotFoundError(f"Missing trained model artifact(s): {', '.join(missing)}")

    def log_run(self, model: str, run_name: str, params: dict, metrics: dict, tags: dict | None = None) -> DataFrame:
        """Params kept if str/int/float/bool, None dropped, else stringified;
        metrics numeric only (bool counts as 1/0)."""
        p = {}
        for k, v in params.items():
            if v is None:
                continue
            p[k] = str(v) if isinstance(v, (str, int, float, bool)) else json.dumps(v) if isinstance(v, (list, dict)) else str(v)
        m = {}
        for k, v in metrics.items():
            if isinstance(v, bool):
                m[k] = 1.0 if v else 0.0
            elif isinstance(v, (int, float)):
                m[k] = float(v)
        schema = T.StructType([
            T.StructField("model", T.StringType()), T.StructField("run_name", T.StringType()),
            T.StructField("params", T.MapType(T.StringType(), T.StringType())),
            T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
            T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
            T.StructField("logged_at", T.TimestampType()),
        ])
        df = self.spark.createDataFrame(
            [(model, run_name, p, m, {k: str(v) for k, v in (tags or {}).items()},
              dt.datetime.now(dt.timezone.utc).replace(tzinfo=None))], schema)
        df.coalesce(1).write.mode("append").parquet(f"{self.root}/_training_runs")
        return df


MEMBER_TYPES = {"isolation_forest": "isolation_forest", "autoencoder": "autoencoder", "logit": "logistic"}


def member_params(model) -> dict:
    """The parameters of an ensemble member as its table keeps them, with the order of the features."""
    params = {k: v for k, v in asdict(model).items() if k != "version"}
    return params | {"features_order": FEATURES_V1}


def record_training(reg: ModelRegistry, name: str, model, run_params: dict, metrics: dict) -> int:
    """S11 + S13: the next version of a member, and the record of the run that made it; it does not go live by that."""
    version = max([0] + reg.versions(name)) + 1
    reg.save(name, version, MEMBER_TYPES[name], member_params(model))
    reg.log_run(name, f"{name}_v{version}", run_params | {"features_order": FEATURES_V1}, metrics | {"version": version})
    return version


def save_model_set(reg: ModelRegistry, version: int, forest, net, logit) -> None:
    """The three ensemble members as parameter tables, made live together."""
    for name, model in (("isolation_forest", forest), ("autoencoder", net), ("logit", logit)):
        reg.save(name, version, MEMBER_TYPES[name], member_params(model))
    reg.set_live_all({name: version for name in MEMBER_TYPES})


def load_model_set(reg: ModelRegistry):
    """Load the live members (missing ones raise) into a scoring ModelSet."""
    from riskflow.models.base import ModelSet
    from riskflow.models.iforest import ForestUDF
    from riskflow.models.params import AutoencoderParams, ForestParams, LogitParams

    reg.require(list(MEMBER_TYPES))
    f = reg.load("isolation_forest")["params"]
    a = reg.load("autoencoder")["params"]
    lg = reg.load("logit")["params"]
    forest = ForestParams(**{k: v for k, v in f.items() if k != "features_order"})
    net = AutoencoderParams(a["mins"], a["maxs"], [(w, b) for w, b in a["layers"]], a["threshold"])
    return ModelSet(if_decision=ForestUDF(forest), ae_mse=net, ae_threshold=net.threshold,
                    proba=LogitParams(lg["weights"], lg["bias"]))
