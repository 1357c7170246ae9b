"""Plans that serve several operators from one scan."""
