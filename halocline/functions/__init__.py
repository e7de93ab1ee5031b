from . import arrays, labels, numeric, physics, text  # noqa: F401
