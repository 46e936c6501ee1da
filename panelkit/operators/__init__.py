"""DataFrame → DataFrame operators (survey §2). Import submodules directly."""
