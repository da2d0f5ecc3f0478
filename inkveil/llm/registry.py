"""The queries of this subpackage, and SQL for those that SQL can express."""

from inkveil.llm import bpe, decontam, langid, licenses, linededup, pii, quality, secrets, simhash, syncmers

QUERIES = {
    "op1_simhash": simhash.query,
    "op2_licenses": licenses.query,
    "op3_langid": langid.query,
    "op4_syncmers": syncmers.query,
    "op5_decontamination": decontam.query,
    "op6_bpe": bpe.query,
    "op7_pii": pii.query,
    "op8_line_dedup": linededup.query,
    "op9_secrets": secrets.query,
    "op10_quality": quality.query,
}
SQL = {"op2_licenses": licenses.SQL, "op5_decontamination": decontam.SQL, "op8_line_dedup": linededup.SQL, "op9_secrets": secrets.SQL}
