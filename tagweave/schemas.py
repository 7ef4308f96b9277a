"""Record shapes used across operators (Spark DDL strings and StructTypes)."""

from pyspark.sql import types as T

TAG = T.StructType([
    T.StructField("tag", T.StringType()),
    T.StructField("explanation", T.StringType()),
])
TAG_LIST = T.ArrayType(TAG)
TAG_LIST_DDL = "array<struct<tag:string,explanation:string>>"

# Cleaned response: text parsed to a tag list when possible, otherwise the
# original string stays in raw_text and the failure class in text_error.
CLEAN_RESPONSE_DDL = (
    "struct<response_id:int,temperature:double,text:" + TAG_LIST_DDL
    + ",raw_text:string,text_error:string>"
)

RESPONSE = T.StructType([
    T.StructField("response_id", T.IntegerType()),
    T.StructField("temperature", T.DoubleType()),
    T.StructField("text", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("generated_at", T.StringType()),
])

# Generation record (one prompt with its sampled responses).
GENERATION_RECORD = T.StructType([
    T.StructField("index", T.LongType()),
    T.StructField("prompt", T.StringType()),
    T.StructField("tagging_prompt", T.StringType()),
    T.StructField("responses", T.ArrayType(RESPONSE)),
    T.StructField("error", T.StringType()),
])

# Source row for SFT / evaluation: parsed_tags is polymorphic, so VARIANT.
SOURCE_ROW_DDL = (
    "index bigint, prompt string, input string, context string, parsed_tags variant"
)

# Judge reply.
JUDGEMENT_DDL = (
    "chosen int, reasoning string, scores struct<"
    "response1:struct<quality:double,diversity:double,privacy:double>,"
    "response2:struct<quality:double,diversity:double,privacy:double>>"
)

# Annotated preference row as written by the judge step.
PREFERENCE_ROW_DDL = (
    "index bigint, prompt string, chosen string, rejected string, scores struct<"
    "quality_chosen:double,quality_rejected:double,diversity_chosen:double,"
    "diversity_rejected:double,diversity_gap:double,privacy_chosen:double,"
    "privacy_rejected:double>, reasoning string"
)

# Training rows as loaded for preference training (chosen/rejected may be a
# tag list or a string in the file, hence VARIANT).
TRAINING_ROW_DDL = "prompt variant, chosen variant, rejected variant, weight variant"

METRIC_COLUMNS = [
    "exact_match_f1", "exact_match_precision", "exact_match_recall",
    "semantic_accuracy", "semantic_f1", "semantic_precision", "semantic_recall",
]
