"""Empty on purpose: the corpus operators are batch operators, and none has a streaming form to match."""
