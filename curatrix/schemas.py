"""Explicit schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_s, _i, _l, _d, _b = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


#: Column names and orders of the interchange tables.
MANIFEST = _struct(sample_id=_s, path=_s, language=_s, source=_s, source_partition=_s, original_label=_s, label=_s, is_unknown=_i, expected_hands=_i, group_id=_s, split=_s, content_sha256=_s, file_bytes=_l)
EXCLUSION = _struct(path=_s, language=_s, source=_s, source_partition=_s, original_label=_s, reason=_s)
INDEX = T.StructType(MANIFEST.fields + _struct(feature_row=_i, usable=_i, landmark_reason=_s, detected_hands=_i, handedness_0=_d, handedness_1=_d, handedness_score_0=_d, handedness_score_1=_d, detection_strategy=_s).fields)
BOX = _struct(xmin=_d, ymin=_d, xmax=_d, ymax=_d)
ANNOTATION = _struct(filename=_s, size=_struct(width=_i, height=_i, depth=_i), object=T.ArrayType(_struct(name=_s, bndbox=BOX)), _corrupt_record=_s)
POINT = _struct(x=_d, y=_d, z=_d)
HAND = _struct(points=T.ArrayType(POINT), handedness=_s, score=_d)
FEATURE_RESULT = _struct(features=T.ArrayType(_d), usable=_b, reason=_s, detected_hands=_i, handedness=T.ArrayType(_d), scores=T.ArrayType(_d))
STORE = _struct(sample_id=_s, features=T.ArrayType(T.FloatType()), usable=_b, reason=_s, detected_hands=_i, handedness=T.ArrayType(T.FloatType()), handedness_scores=T.ArrayType(T.FloatType()), strategy=_s, chunk_index=_i, generation_key=_s)
LAYER = _struct(inputSize=_i, outputSize=_i, activation=_s, weights=T.ArrayType(T.ArrayType(_d)), bias=T.ArrayType(_d))
MODEL = _struct(schemaVersion=_i, mode=_s, featureVersion=_s, featureCount=_i, classes=T.ArrayType(_s), confidenceThreshold=_d, expectedHands=T.MapType(_s, _i), inferencePolicy=_s, scaler=_struct(mean=T.ArrayType(_d), scale=T.ArrayType(_d)), layers=T.ArrayType(LAYER))
