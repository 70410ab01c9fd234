"""No operator of this library consumes streams: a record's window is a pair of numbers that is
compared for equality, and every build reads the whole store."""
