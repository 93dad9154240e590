from . import geometry
