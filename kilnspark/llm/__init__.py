"""Large-scale training-data operators. Nothing outside this subpackage imports it."""
