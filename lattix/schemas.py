"""Record types, their codes and the schemas that the importers give."""

from __future__ import annotations

from pyspark.sql import types as T

# The codes of vertex and edge types. A vertex type's code is also the column that holds its id.
VERTEX_CODES = {"PERSON": 1, "FORUM": 3, "FORUMEVENT": 4, "PUBLICATION": 5, "TOPIC": 6}
EDGE_CODES = {"PURCHASE": 7, "SALE": 8, "AUTHOR": 9, "WRITTENBY": 10, "INCLUDES": 11, "INCLUDEDIN": 12, "HASTOPIC": 13, "TOPICIN": 14, "HASORG": 15, "ORG_IN": 16, "DEVICE": 17, "FRIEND": 18, "USES": 19, "COMMUNICATION": 20, "NONE": 21}
CODES = VERTEX_CODES | EDGE_CODES

# The type of the edge that each edge record also gives in the other direction.
INVERSES = {"SALE": "PURCHASE", "PURCHASE": "SALE", "AUTHOR": "WRITTENBY", "INCLUDES": "INCLUDEDIN", "HASTOPIC": "TOPICIN", "HASORG": "ORG_IN"}

# Classes of the vertex classifier.
CLASSES = {"PERSON": 0, "FORUMEVENT": 1, "FORUM": 2, "PUBLICATION": 3, "TOPIC": 4}

# The topic of the commercial network that is projected; relations of the reasoning graph; institutions that are no universities.
PROJECTED_TOPIC = 8486
RELATIONS = {"award-winner": 207, "works-in": 3, "affiliated-with": 40}
NO_UNIVERSITY = (22174494, 78111271, 51562303, 344618, 4209802, 9294723, 35693055)

#: Columns of the record file, by position.
RECORD_COLUMNS = 10
LABEL, PERSON, PERSON_TO, FORUM, EVENT, PUBLICATION, TOPIC = range(7)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


_L, _S, _D = T.LongType(), T.StringType(), T.DoubleType()
EDGE = _struct(src=_L, dst=_L)
RECORD_VERTEX = _struct(id=_L, type=_S)
RECORD_EDGE = _struct(src=_L, dst=_L, type=_S, src_type=_S, dst_type=_S)
NETWORK_EDGE = _struct(src=_L, dst=_L, type=_S, src_type=_S, dst_type=_S, amount=_D, topic=_L, epoch_time=_L, duration=_L, protocol=_L, src_port=_L, dst_port=_L, src_packets=_L, dst_packets=_L, src_bytes=_L, dst_bytes=_L)
RELATION_EDGE = _struct(src=_L, dst=_L, type=_L, mirror=T.BooleanType())
EMBEDDING = _struct(id=_L, features=T.ArrayType(_D))
WEIGHTED_EDGE = _struct(src=_L, dst=_L, value=_D)
