"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from marlstone.llm import chat, exactdup, linedup
from marlstone.llm.chat import op4_chat_formatting
from marlstone.llm.decontam import op2_benchmark_decontamination
from marlstone.llm.exactdup import op9_exact_dedup
from marlstone.llm.linedup import op10_line_dedup
from marlstone.llm.packing import op1_best_fit_packing
from marlstone.llm.pii import op7_pii_pseudonyms
from marlstone.llm.quality import op5_quality_classifier
from marlstone.llm.simhash import op8_simhash_near_dedup
from marlstone.llm.tokenfile import op3_token_id_files
from marlstone.llm.toxicity import op6_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_benchmark_decontamination,
        op3_token_id_files,
        op4_chat_formatting,
        op5_quality_classifier,
        op6_toxicity,
        op7_pii_pseudonyms,
        op8_simhash_near_dedup,
        op9_exact_dedup,
        op10_line_dedup,
    )
}

SQL: dict[str, str] = {"op4_chat_formatting": chat.SQL, "op9_exact_dedup": exactdup.SQL, "op10_line_dedup": linedup.SQL}
