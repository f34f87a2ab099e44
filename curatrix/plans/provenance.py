"""Content-addressed runs and contracts of artifacts (O-101, O-102, O-122, O-123, O-132)."""

from __future__ import annotations

import hashlib
import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def canonical(value: object) -> str:
    """O-101: JSON with sorted keys and no spaces; letters beyond ASCII are escaped, so digests depend on no encoding."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"))


def generation_key(**parts: object) -> str:
    """O-102: SHA-256 of the canonical JSON of all that a run depends on."""
    return hashlib.sha256(canonical(parts).encode()).hexdigest()


def stale(state: dict | None, summary: dict | None, store: dict | None, *, feature_version: str, feature_count: int, manifest_sha256: str, model_sha256: str | None, key: str) -> str | None:
    """O-122: the first reason why an extraction cannot be trained on, or None."""
    checks = (
        (lambda: state is None, "missing extraction state"),
        (lambda: state.get("status") != "complete", "extraction is not complete"),
        (lambda: (state.get("feature_version"), state.get("feature_count")) != (feature_version, feature_count), "feature schema does not match"),
        (lambda: model_sha256 is None, "detector model is missing"),
        (lambda: state.get("generation_key") != key, "stale extraction state"),
        (lambda: summary is None, "missing summary"),
        (lambda: summary.get("generation_key") != key, "summary does not match the state"),
        (lambda: store is None or not {"generation_key", "manifest_sha256", "model_sha256", "feature_version"} <= store.keys(), "store has no provenance"),
        (lambda: store["generation_key"] != key, "stale store"),
        (lambda: store["manifest_sha256"] != manifest_sha256, "stale manifest digest"),
        (lambda: store["model_sha256"] != model_sha256, "stale detector digest"),
        (lambda: store["feature_version"] != feature_version, "stale feature version"),
    )
    return next((reason for failed, reason in checks if failed()), None)


def model_problem(model: dict, *, mode: str, feature_version: str = "hand-pose-v2", feature_count: int = 132, policy: str | None = None, classes: list[str] | None = None, profile: dict | None = None) -> str | None:
    """O-123: the first way in which a model breaks its contract, or None. ``classes`` (in any order) and the detector ``profile`` (by its canonical JSON) are checked where the contract has them."""

    def finite(values: object) -> bool:
        return isinstance(values, list) and all(isinstance(v, int | float) and math.isfinite(v) for v in values)

    if model.get("schemaVersion") != 1 or model.get("mode") != mode:
        return "schema or mode"
    if model.get("featureVersion") != feature_version or model.get("featureCount") != feature_count:
        return "features"
    if policy is not None and model.get("inferencePolicy") != policy:
        return "policy"
    named = model.get("classes")
    if not isinstance(named, list) or len(set(named)) != len(named) or "UNKNOWN" not in named or (classes is not None and sorted(named) != sorted(classes)):
        return "classes"
    if profile is not None and canonical(model.get("detectorProfile")) != canonical(profile):
        return "detector profile"
    threshold = model.get("confidenceThreshold")
    if not isinstance(threshold, int | float) or not 0 <= threshold <= 1:
        return "threshold"
    routes = model.get("expectedHands", {})
    if any(routes.get(c) not in (0, 1, 2) for c in named) or routes["UNKNOWN"] != 0:
        return "routes"
    scaler = model.get("scaler", {})
    if not all(finite(scaler.get(k)) and len(scaler[k]) == feature_count for k in ("mean", "scale")) or min(scaler["scale"]) <= 0:
        return "scaler"
    width = feature_count
    for layer in model.get("layers") or []:
        rows = layer.get("weights", [])
        if layer.get("inputSize") != width or len(rows) != width or any(not finite(r) or len(r) != layer.get("outputSize") for r in rows) or not finite(layer.get("bias")) or len(layer["bias"]) != layer["outputSize"]:
            return "layers"
        width = layer["outputSize"]
    if not model.get("layers") or width != len(named) or model["layers"][-1].get("activation") != "softmax":
        return "layers"
    return None


def _json(text: str | None) -> dict | None:
    """A control file's object; null, broken JSON and other values are None."""
    try:
        value = json.loads(text or "null")
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def audit_artifacts(files: DataFrame, *, feature_version: str, feature_count: int, profile: dict, policy: dict) -> DataFrame:
    """O-122 over files (path, content): (run, reason) for every folder that holds a manifest.csv, model.task, state.json, summary.json and store.json, or some of them.

    Digests are those of the files as they are; the key is that of the contract, the digests, the detector's profile and the recovery policy.
    """
    run, kind = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1), F.regexp_extract("path", r"([^/]+)$", 1)
    named = files.select(run.alias("run"), kind.alias("kind"), F.sha2("content", 256).alias("digest"), F.col("content").cast("string").alias("text"))
    pick = lambda name, column: F.max(F.when(F.col("kind") == name, F.col(column)))
    runs = named.groupBy("run").agg(pick("manifest.csv", "digest").alias("manifest"), pick("model.task", "digest").alias("model"), *(pick(f"{n}.json", "text").alias(n) for n in ("state", "summary", "store")))

    def check(parts):
        for part in parts:
            reasons = []
            for r in part.astype(object).where(part.notna(), None).itertuples():
                key = generation_key(feature_version=feature_version, feature_count=feature_count, manifest_sha256=r.manifest, model_sha256=r.model, detector_profile=profile, recovery_policy=policy)
                reasons.append(stale(_json(r.state), _json(r.summary), _json(r.store), feature_version=feature_version, feature_count=feature_count, manifest_sha256=r.manifest, model_sha256=r.model, key=key))
            yield part[["run"]].assign(reason=reasons)

    return runs.mapInPandas(check, "run string, reason string")


def audit_models(files: DataFrame, **contract: object) -> DataFrame:
    """O-16, O-123 over model files (path, content): (path, problem) by the contract's ``model_problem``; what is no JSON object is ``unreadable``."""

    def check(parts):
        for part in parts:
            models = [_json(None if c is None else bytes(c).decode("utf-8", "replace")) for c in part["content"]]
            yield part[["path"]].assign(problem=["unreadable" if m is None else model_problem(m, **contract) for m in models])

    return files.select("path", "content").mapInPandas(check, "path string, problem string")


def consolidate(store: DataFrame, order: DataFrame, keys: dict[int, str], width: int = 132) -> DataFrame:
    """O-132: all chunks in the manifest's order; a stale chunk, a missing row or a short vector is an error.

    ``order`` has sample_id and feature_row; ``keys`` the key of each chunk.
    """
    wanted = F.create_map(*(F.lit(x) for kv in keys.items() for x in kv)) if keys else F.lit(None)
    bad = store.agg(F.count_if(~F.col("generation_key").eqNullSafe(wanted[F.col("chunk_index")]) if keys else F.lit(True)).alias("stale"), F.count_if(F.coalesce(F.size("features"), F.lit(-1)) != width).alias("short"), F.count("*").alias("n")).first()
    if bad["stale"] or bad["short"]:
        raise ValueError(f"{bad['stale']} rows of stale chunks, {bad['short']} short vectors")
    if bad["n"] != order.count():
        raise ValueError("row counts differ")
    return order.join(store, "sample_id").orderBy("feature_row")
