"""Spark types of the tables that operators exchange. Order columns are explicit: rows have no order of their own."""

from pyspark.sql import types as T


#: By name, so that workers can import this without a session.
TYPES = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "timestamp": T.TimestampType(), "array<string>": T.ArrayType(T.StringType())}


def fields(**kinds: T.DataType | str) -> T.StructType:
    return T.StructType([T.StructField(k, TYPES[v] if isinstance(v, str) else v) for k, v in kinds.items()])


ORDER = {"run_id": "string", "model_idx": "int", "chunk_idx": "int", "ord": "int"}
LOCATION = fields(path="string", hunk="string", lines=fields(start="int", end="int"), commit="string", snippet="string")
RAW_FINDING = fields(severity="string", category="string", title="string", message="string", suggestion="string", confidence="double", path="string", startLine="int", endLine="int", tags="array<string>")
FINDING = fields(**ORDER, id="string", severity="string", category="string", title="string", message="string", suggestion="string", confidence="double", path="string", start_line="int", end_line="int", commit="string", tags="array<string>")
SECTION = fields(run_id="string", section_ord="int", path="string", body="string", n_bytes="int")
CHUNK = fields(run_id="string", chunk_idx="int", diff="string", files="array<string>")
DIFF = fields(run_id="string", diff="string", files="array<string>", mode="string", range="string", repo=fields(root="string", head="string", branch="string"))
COMMIT = fields(commit_ord="int", sha="string", subject="string")
CACHE_ENTRY = fields(key="string", response="string", created_at="timestamp", ttl="int")
REQUEST = fields(run_id="string", chunk_idx="int", label="string", system_prompt="string", user_prompt="string", max_tokens="int")
RESPONSE = fields(run_id="string", chunk_idx="int", label="string", content="string", tokens_used="int", llm_ms="long", error="string")
