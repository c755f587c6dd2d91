"""Physical-plan helpers: size-checked broadcasts, distributed ranks."""
