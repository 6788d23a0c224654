"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.llm.bpe import op9_bpe
from tessella.llm.langid import op8_language
from tessella.llm.merkle import op11_merkle, op11_sql
from tessella.llm.mixing import op2_mixing, op2_sql
from tessella.llm.phrases import op13_collocations, op13_sql
from tessella.llm.pii import op4_pii
from tessella.llm.png import op7_png
from tessella.llm.setsketch import op12_minhash
from tessella.llm.sharding import op1_sharding, op1_sql
from tessella.llm.simhash import op5_simhash
from tessella.llm.substrings import op3_sql, op3_substrings
from tessella.llm.syncmers import op6_syncmers
from tessella.llm.toxicity import op10_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_mixing": op2_mixing,
    "op3_substrings": op3_substrings,
    "op4_pii": op4_pii,
    "op5_simhash": op5_simhash,
    "op6_syncmers": op6_syncmers,
    "op7_png": op7_png,
    "op8_language": op8_language,
    "op9_bpe": op9_bpe,
    "op10_toxicity": op10_toxicity,
    "op11_merkle": op11_merkle,
    "op12_minhash": op12_minhash,
    "op13_collocations": op13_collocations,
}

ORACLE_SQL: dict[str, str] = {
    "op1_sharding": op1_sql(),
    "op2_mixing": op2_sql(),
    "op3_substrings": op3_sql(),
    "op11_merkle": op11_sql(),
    "op13_collocations": op13_sql(),
}
