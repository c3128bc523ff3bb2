"""Fixed schemas and constants of the event table. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

NEVER = (1 << 63) - 1
DELETION, VANISH, GIFT_WRAP, PROFILE, CARD, PROVIDERS = 5, 62, 1059, 0, 30382, 10040

EVENT = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("pubkey", T.StringType()),
        T.StructField("created_at", T.LongType()),
        T.StructField("kind", T.IntegerType()),
        T.StructField("tags", T.ArrayType(T.ArrayType(T.StringType()))),
        T.StructField("content", T.StringType()),
        T.StructField("sig", T.StringType()),
    ]
)
#: Text columns that search reads, in order.
SEARCH_FIELDS = ("name", "display_name", "about", "nip05", "lud16", "website", "search_primary", "search_secondary", "search_text", "search_location")
NEAR_FIELDS = ("name_near", "search_primary_near", "search_secondary_tokens", "affil_tokens")
REPUTATION = T.StructType([T.StructField("subject", T.StringType()), T.StructField("observer", T.StringType()), T.StructField("influence", T.IntegerType()), T.StructField("followers", T.FloatType())])

