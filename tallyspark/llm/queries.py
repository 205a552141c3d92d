"""The queries of this subpackage, and SQL for those that SQL can express."""

from . import chat, compaction, decontam, lines, media, mixing, quality, simhash, substrings, toxicity

_ALL = [
    (quality.op1_quality, quality.ORACLE),
    (media.op2_media_sniffing, media.ORACLE),
    (decontam.op3_decontamination, decontam.ORACLE),
    (mixing.op4_mixing, mixing.ORACLE),
    (substrings.op5_substring_dedup, substrings.ORACLE),
    (lines.op6_line_dedup, lines.ORACLE),
    (compaction.op7_sharding, compaction.ORACLE),
    (simhash.op8_simhash, simhash.ORACLE),
    (toxicity.op9_toxicity, toxicity.ORACLE),
    (chat.op10_chat_windows, chat.ORACLE),
]
QUERIES = {f.__name__: f for f, _ in _ALL}
ORACLE = {f.__name__: sql for f, sql in _ALL if sql}
