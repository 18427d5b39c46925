from lodestone.plans.app import main

main()
