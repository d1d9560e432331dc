"""tidemark subpackage."""
