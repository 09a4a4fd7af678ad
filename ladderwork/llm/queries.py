"""The corpus operators as queries over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from .alignment import alignment_report
from .chats import FORMATTED_SQL, formatted_chats
from .decontamination import contamination_digest
from .fingerprints import fingerprint_report
from .jaccard import jaccard_components
from .licenses import license_matches
from .periods import run_digest
from .pieces import round_trip
from .pii import personal_data_digest
from .quality import quality_digest
from .revisits import REVISIT_SQL, revisit_report
from .scoring import scored
from .shared import table
from .substrings import deduplicated_digest

#: Vocabulary file of the encoding query.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
#: Vocabulary file of the other side of the alignment query.
BYTE_LEVEL_PATH = "/opt/tokenizers/byte_bpe_50k.json"

QUERIES = {
    "op1_decontamination": lambda spark, d: contamination_digest(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op2_fingerprints": lambda spark, d: fingerprint_report(table(spark, d, "documents")),
    "op3_chats": lambda spark, d: formatted_chats(table(spark, d, "conversations")),
    "op4_substrings": lambda spark, d: deduplicated_digest(table(spark, d, "documents")),
    "op5_quality": lambda spark, d: quality_digest(table(spark, d, "documents"), table(spark, d, "labels")),
    "op6_pieces": lambda spark, d: round_trip(table(spark, d, "documents"), MODEL_PATH),
    "op7_licenses": lambda spark, d: license_matches(table(spark, d, "documents")),
    "op8_revisits": lambda spark, d: revisit_report(table(spark, d, "pages")),
    "op9_jaccard": lambda spark, d: jaccard_components(table(spark, d, "documents")),
    "op10_pii": lambda spark, d: personal_data_digest(table(spark, d, "documents")),
    "op11_alignment": lambda spark, d: alignment_report(table(spark, d, "documents"), BYTE_LEVEL_PATH, MODEL_PATH),
    "op12_scoring": lambda spark, d: scored(table(spark, d, "documents")),
    "op13_periods": lambda spark, d: run_digest(table(spark, d, "documents")),
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {"op3_chats": FORMATTED_SQL, "op8_revisits": REVISIT_SQL}
