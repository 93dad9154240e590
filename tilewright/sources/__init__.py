from . import annotations, pyramids
