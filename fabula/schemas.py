"""Explicit schemas of the story relations; nothing is inferred."""

from pyspark.sql import types as T

S, I, D, L, B = T.StringType(), T.IntegerType(), T.DoubleType(), T.LongType(), T.BooleanType()


def _schema(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


SCENE = _schema(script_id=L, ordinal=I, episode_no=I, scene_no=S, label=S, characters=T.ArrayType(S), start_line=I, end_line=I, text=S)
UNIT = _schema(script_id=L, unit_id=L, idx=I, episode_no=I, start_line=I, end_line=I, summary=S)
UNIT_TAG = _schema(script_id=L, unit_id=L, dim=S, value=S, score=D, confidence=D, ord=I)
SCRIPT_TAG = _schema(script_id=L, dim=S, value=S, confidence=D, ord=I)
EPISODE_TAG = _schema(script_id=L, episode_no=I, dim=S, value=S)
ENTITY = _schema(script_id=L, char_id=S, name=S, role=S, agency_level=S, appearances=L)
RELATIONSHIP = _schema(script_id=L, src=S, dst=S, type=S, polarity=S, dynamic_arc=S)
SIGNAL = _schema(script_id=L, key=S, score=D, confidence=D)
RUBRIC = _schema(dimension=S, key=S, weight=D)
LINE = _schema(script_id=L, para_idx=I, line=S)
FRAME = _schema(run_id=L, seq=L, frame=S, ts=T.TimestampType())
