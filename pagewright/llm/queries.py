"""The corpus queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from pagewright.llm import line_dedup, minhash, substring_dedup, warc
from pagewright.llm.ann import op4_nearest
from pagewright.llm.mixing import op10_mixing
from pagewright.llm.packing import op2_packing
from pagewright.llm.pii import op7_pii
from pagewright.llm.prefix_hash import op5_fingerprints
from pagewright.llm.quality import op9_quality
from pagewright.llm.simhash import op1_simhash
from pagewright.llm.spelling import op13_spelling
from pagewright.llm.whitening import op12_whitening

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_packing": op2_packing,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_nearest": op4_nearest,
    "op5_fingerprints": op5_fingerprints,
    "op6_warc": warc.op6_warc,
    "op7_pii": op7_pii,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_quality": op9_quality,
    "op10_mixing": op10_mixing,
    "op11_minhash": minhash.op11_minhash,
    "op12_whitening": op12_whitening,
    "op13_spelling": op13_spelling,
}

ORACLE = {
    "op3_line_dedup": line_dedup.ORACLE,
    "op6_warc": warc.ORACLE,
    "op8_substring_dedup": substring_dedup.ORACLE,
    "op11_minhash": minhash.ORACLE,
}
