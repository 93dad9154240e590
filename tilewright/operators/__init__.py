from . import annotations, grids, spatial, summaries
