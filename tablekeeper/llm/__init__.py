"""Operators for preparing training text at scale.

Nothing else in the library imports this subpackage.  The operators share one
shape: documents are packed into *blocks* of a few megabytes (``blocks.py``);
each task turns a block into numpy arrays; what has to meet other blocks is
collapsed inside its block first, so that a group of copies costs one entry a
block rather than one a document; and the answers come back to the block as
bits.  No operator sends rows, links or fingerprints of the corpus to the
driver.
"""
