"""Named outputs composed from the operators."""
