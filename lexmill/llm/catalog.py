"""Named queries of the subpackage (pN_...)."""

from lexmill.llm import bins, leaks, mixing, neardup, oracle, overlap, pieces, sampling, sentences, splits

QUERIES = {
    "p1_found": splits.p1_found,
    "p1_assign": splits.p1_assign,
    "p1_shares": splits.p1_shares,
    "p2_found": leaks.p2_found,
    "p2_report": leaks.p2_report,
    "p3_found": overlap.p3_found,
    "p3_counts": overlap.p3_counts,
    "p4_found": neardup.p4_found,
    "p4_groups": neardup.p4_groups,
    "p5_found": sampling.p5_found,
    "p5_sample": sampling.p5_sample,
    "p5_report": sampling.p5_report,
    "p6_found": sentences.p6_found,
    "p6_counts": sentences.p6_counts,
    "p7_bins": bins.p7_bins,
    "p7_fill": bins.p7_fill,
    "p8_found": mixing.p8_found,
    "p8_mix": mixing.p8_mix,
    "p8_shares": mixing.p8_shares,
    "p9_found": pieces.p9_found,
    "p9_pieces": pieces.p9_pieces,
}
ORACLE = oracle.ORACLE
