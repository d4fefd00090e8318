"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from .op2_sharding import SQL as SHARDING_SQL
from .op6_mixing import SQL as MIXING_SQL
from .op1_packing import op1_packing
from .op2_sharding import op2_sharding
from .op3_order_minhash import op3_order_minhash
from .op4_url_rules import op4_url_rules
from .op5_simhash import op5_simhash
from .op6_mixing import op6_mixing
from .op7_toxicity import op7_toxicity
from .op8_html import op8_html
from .op9_embeddings import op9_embeddings
from .op10_language_id import op10_language_id

QUERIES = {f.__name__: f for f in (op1_packing, op2_sharding, op3_order_minhash, op4_url_rules, op5_simhash, op6_mixing, op7_toxicity, op8_html, op9_embeddings, op10_language_id)}
ORACLE_SQL = {"op2_sharding": SHARDING_SQL, "op6_mixing": MIXING_SQL}
