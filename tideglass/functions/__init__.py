"""Column functions: one definition of each rule, used by batch and streaming alike."""
