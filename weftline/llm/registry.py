"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from weftline.llm import bpe, curriculum, jaccard, language, paragraphs, permutations, pii, secrets, vectors, warc

QUERIES = {
    "op1_embedding_neardup": vectors.op1_embedding_neardup,
    "op2_language_id": language.op2_language_id,
    "op3_permutation_search": permutations.op3_permutation_search,
    "op4_warc_from_arc": warc.op4_warc_from_arc,
    "op5_ngram_jaccard_join": jaccard.op5_ngram_jaccard_join,
    "op6_secret_scan": secrets.op6_secret_scan,
    "op7_byte_bpe": bpe.op7_byte_bpe,
    "op8_curriculum_mix": curriculum.op8_curriculum_mix,
    "op9_repeated_paragraphs": paragraphs.op9_repeated_paragraphs,
    "op10_contextual_pii": pii.op10_contextual_pii,
}
SQL = {
    "op1_embedding_neardup": vectors.OP1_SQL,
    "op4_warc_from_arc": warc.OP4_SQL,
    "op5_ngram_jaccard_join": jaccard.OP5_SQL,
    "op8_curriculum_mix": curriculum.OP8_SQL,
}
