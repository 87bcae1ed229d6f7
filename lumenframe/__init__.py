"""Media-catalog analytics as lazy DataFrame operators."""
