"""The queries of this package, by name, and their SQL where there is any."""

from .bpe import op8_bpe
from .chat import op7_chat
from .decontaminate import op2_decontaminate
from .exact_dedup import op3_exact_dedup
from .langid import op1_langid
from .lm import op5_lm
from .quality import op6_quality
from .sharding import op9_sharding
from .simhash import op4_simhash
from .urls import op10_urls

QUERIES = {
    f.__name__: f
    for f in (op1_langid, op2_decontaminate, op3_exact_dedup, op4_simhash, op5_lm, op6_quality, op7_chat, op8_bpe, op9_sharding, op10_urls)
}

ORACLE_SQL = {
    "op3_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
}
