class KeeperError(ValueError):
    """A request that cannot be run as asked: bad rule, missing block, empty history."""
