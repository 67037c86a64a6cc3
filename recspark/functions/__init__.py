from recspark.functions.vectors import dot, norm, cosine, clip
from recspark.functions.hashing import ab_group, unit_hash

__all__ = ["dot", "norm", "cosine", "clip", "ab_group", "unit_hash"]
