"""The installation file: which channel feeds which measurement point, and the stop reasons."""

from __future__ import annotations

import datetime as dt
import re
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.catalog import QUANTITIES
from ..operators.validate import NAME, POINT, mapping_faults, overlaps

# The size limit and the keys of the file.
MAX_BYTES = 4 << 20
TOP = {"instalacao", "motivos_de_parada", "pontos_de_medicao"}
REASONS = {"versao", "codigos"}
ROW = {"dispositivo", "modulo", "canal", "ponto", "grandeza", "unidade", "faixa_minima", "faixa_maxima", "vigente_de", "vigente_ate"}
MAPPING = (
    "dispositivo string, modulo long, canal long, ponto string, grandeza string, unidade string, faixa_minima double, faixa_maxima double, "
    "vigente_de timestamp, vigente_ate timestamp"
)


def _strict(found: object, known: set[str], where: str) -> dict:
    found = {} if found is None else found
    if not isinstance(found, dict):
        raise ValueError(f"{where}: not a mapping")
    if unknown := set(found) - known:
        raise ValueError(f"{where}: unknown keys {sorted(map(str, unknown))}")
    return found


def instant(raw: str | None, where: str) -> dt.datetime | None:
    """A day, midnight UTC, or an instant with its zone; blank is open."""
    text = "" if raw is None else str(raw).strip()
    if not text:
        return None
    exact = re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)", text)
    if not exact and not re.fullmatch(r"\d{4}-\d\d-\d\d", text):
        raise ValueError(f"{where}: {text!r} is neither a day nor an instant with its zone")
    try:
        at = dt.datetime.fromisoformat(text)
    except ValueError as bad:
        raise ValueError(f"{where}: {text!r} does not exist") from bad
    return at.astimezone(dt.timezone.utc) if exact else at.replace(tzinfo=dt.timezone.utc)


def _whole(value: object, where: str) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or not 0 <= value < 1 << 32:
        raise ValueError(f"{where}: {value!r} is no unsigned 32-bit number")
    return value


def _row(raw: object, where: str) -> tuple:
    row = _strict(raw, ROW, where)
    name = {k: str(row.get(k) or "") for k in ("dispositivo", "ponto", "grandeza", "unidade")}
    for key, pattern, most in (("dispositivo", NAME, 64), ("ponto", POINT, 128)):
        if not re.match(pattern.replace(r"\z", r"\Z"), name[key]) or len(name[key].encode()) > most:
            raise ValueError(f"{where}: invalid {key} {name[key]!r}")
    quantity = name["grandeza"].strip().lower()
    if quantity not in QUANTITIES.values() or quantity == QUANTITIES[0]:
        raise ValueError(f"{where} ({name['ponto']}): unknown quantity {quantity!r}")
    bounds = [None if row.get(k) is None else float(row[k]) for k in ("faixa_minima", "faixa_maxima")]
    times = [instant(row.get(k), f"{where}: {k}") for k in ("vigente_de", "vigente_ate")]
    return name["dispositivo"], _whole(row.get("modulo", 0), where), _whole(row.get("canal", 0), where), name["ponto"], quantity, name["unidade"].strip(), *bounds, *times


def load_installation(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    """The mapping, the stop reasons, and the id of the installation with the version of its reasons.

    Anything wrong is an error that names the entry: unknown keys, a file above 4 MiB, bad names, quantities, ranges
    and validities, overlaps, reason code 0, no points. The file is small by that limit, so the driver reads it.
    """
    try:
        import yaml
    except ImportError as missing:
        raise RuntimeError("reading an installation file needs PyYAML") from missing

    class Loader(yaml.SafeLoader):
        """Dates stay text, so that their zone is not guessed, and repeated keys are an error."""

        def construct_mapping(self, node, deep=False):
            keys = [self.construct_object(k, deep=True) for k, _ in node.value]
            if len(keys) != len(set(keys)):
                raise ValueError(f"repeated key{node.start_mark}")
            return super().construct_mapping(node, deep)

    Loader.yaml_implicit_resolvers = {c: [r for r in rs if r[0] != "tag:yaml.org,2002:timestamp"] for c, rs in yaml.SafeLoader.yaml_implicit_resolvers.items()}
    file = Path(path)
    if file.stat().st_size > MAX_BYTES:
        raise ValueError(f"{path} is above {MAX_BYTES} bytes")
    top = _strict(yaml.load(file.read_text("utf-8"), Loader), TOP, path)
    name = str(top.get("instalacao") or "").strip()
    if not 1 <= len(name.encode()) <= 64:
        raise ValueError("the installation needs a name of 1 to 64 bytes")
    rows = [_row(r, f"ponto_de_medicao[{i}]") for i, r in enumerate(top.get("pontos_de_medicao") or [])]
    if not rows:
        raise ValueError("the installation has no points")
    kinds = _strict(top.get("motivos_de_parada"), REASONS, "motivos_de_parada")
    reasons = [(_whole(code, "motivos_de_parada"), str(text)) for code, text in (kinds.get("codigos") or {}).items()]
    if any(code == 0 for code, _ in reasons):
        raise ValueError("reason code 0 is reserved")
    mapping = spark.createDataFrame(rows, MAPPING)
    if fault := mapping_faults(mapping).first():
        raise ValueError(f"{fault['ponto']}: {fault['motivo']}")
    if mapping.groupBy(*mapping.columns).count().filter("count > 1").head(1):
        raise ValueError("an entry is repeated")
    for keys in (["dispositivo", "modulo", "canal"], ["ponto"]):
        if clash := overlaps(mapping, keys).select("_id.ponto", F.col("_id2.ponto").alias("other")).first():
            raise ValueError(f"validities overlap: {clash['ponto']} and {clash['other']}")
    # From Arrow, Spark knows the table's size and so may broadcast it.
    known = pa.table({"codigo": pa.array([c for c, _ in reasons], pa.int64()), "rotulo": pa.array([t for _, t in reasons], pa.string())})
    return mapping, spark.createDataFrame(known), {"id": name, "versao_dos_motivos": _whole(kinds.get("versao", 0), "versao")}
