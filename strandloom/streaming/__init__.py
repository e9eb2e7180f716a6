"""Nothing here is a stream: every table of the reconstruction is bounded, and
each result needs its whole input (collapsed kmers, shared sets, shares that
sum to one). The operators take any batch DataFrame."""
