"""The registered queries of this subpackage and, where SQL can express them, their SQL twins."""

from __future__ import annotations

from . import chat, chunks, contain, forest, jaccard, licences, pieces, quality, suffixes, tokens

QUERIES = {
    "op1_token_files": tokens.op1,
    "op2_substring_dedup": chunks.op2,
    "op3_sentencepiece_dropout": pieces.op3,
    "op4_chat_preferences": chat.op4,
    "op5_quality_classifier": quality.op5,
    "op6_suffix_dedup": suffixes.op6,
    "op7_ngram_jaccard_join": jaccard.op7,
    "op8_embedding_near_dedup": forest.op8,
    "op9_benchmark_decontamination": contain.op9,
    "op10_licence_scan": licences.op10,
}

SQL = {
    "op4_chat_preferences": chat.SQL,
    "op7_ngram_jaccard_join": jaccard.SQL,
    "op9_benchmark_decontamination": contain.SQL,
    "op10_licence_scan": licences.SQL,
}
