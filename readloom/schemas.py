"""Column layouts shared by operators, files and jobs (fixed values)."""

from pyspark.sql import types as T

FWD, REV = 0, 1


def _struct(spec: str) -> T.StructType:
    kinds = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType()}
    fields = (part.split(":") for part in spec.split())
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in fields])


SEQUENCES = _struct("name:string comment:string seq:string qual:string")
READS = _struct("read_id:long seq:string len:int offset:long")
SEEDS = _struct("qid:long qdir:int sid:long qoff:int soff:int")
# Text files keep these column orders.
CANDIDATES = _struct(
    "qid:long sid:long score:int qdir:int qbeg:int qend:int qoff:int qsize:int"
    " sdir:int sbeg:int send:int soff:int ssize:int"
)
OVERLAPS = _struct(
    "qid:long sid:long ident_perc:double vscore:int qdir:int qoff:int qend:int qext:int qsize:int"
    " sdir:int soff:int send:int sext:int ssize:int"
)
CORRECTED = _struct("id:long org_size:int left:int right:int seq:string")
