"""The operators over frames with the columns ``k`` and ``v``."""
